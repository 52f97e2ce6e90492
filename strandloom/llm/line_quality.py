"""Quality rules on text statistics and on how often lines recur across a host's documents.

The base rules reject texts with fewer than MIN_WORDS words, or with more than a fifth
of their words in repeated five-word windows. For the line rule each line is
normalised (lower case, digits and white space squeezed) and hashed with its host; a
line that occurs in MIN_DOCS documents of a host or more, and in more than SHARE of
them, is taken out: clean() gives the texts without such lines. A document that keeps
less than KEEP of its word characters is depleted and rejected.

All of it is DataFrame expressions. Counting needs one row for each line and document;
frequent lines are grouped before they are shuffled, and joined back by hash.

Defined results: a null text counts as empty and fails the base rules; null hosts are
one host; rows that share a doc_id are one document to the line rule, null ids too;
repeated rows give repeated results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, WINDOW = 10, 5
MIN_DOCS, SHARE, KEEP = 10, 0.002, 0.5

_SPACE = r"' \t\n\u000B\u000C\r'"
_CHARS = lambda x: f"length(translate({x}, {_SPACE}, ''))"
_KEY = lambda host, x: rf"xxhash64({host}, trim(regexp_replace(lower({x}), '[ \\t\\n\\x0B\\f\\r0-9]+', ' ')))"
_WORDS = r"filter(split(t, '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.selectExpr("doc_id", "t", f"{_WORDS} AS w", f"filter(split(t, '\\n'), x -> trim(BOTH {_SPACE} FROM x) <> '') AS lines")
    d = d.selectExpr(
        "doc_id",
        "size(w) AS n_words",
        f"length(translate(t, {_SPACE}, '')) AS word_chars",
        "length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols",
        "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
        "transform(w, x -> xxhash64(x)) AS h",
    )
    after = ", ".join(f"get(h, i + {k})" for k in range(1, WINDOW))
    d = d.selectExpr("* EXCEPT (h)", f"IF(n_words < {WINDOW}, array(), transform(slice(h, 1, greatest(0, n_words - {WINDOW - 1})), (x, i) -> xxhash64(x, {after}))) AS g")
    d = d.selectExpr("*", "sort_array(g) AS s")
    d = d.selectExpr("* EXCEPT (s)", "exists(transform(s, (x, i) -> x = get(s, i + 1)), y -> y) AS again")
    # Only texts with a repeated window are sorted with positions.
    d = d.selectExpr("* EXCEPT (g, again)", "IF(again, sort_array(transform(g, (x, i) -> struct(x AS h, i AS p))), array()) AS o")
    d = d.selectExpr("* EXCEPT (o)", "sort_array(transform(filter(o, (e, k) -> e.h <=> get(o, k - 1).h OR e.h <=> get(o, k + 1).h), e -> e.p)) AS p")
    covered = f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1), x + {WINDOW}) - x)), 0, (a, x) -> a + x)"
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    return d.selectExpr("doc_id", *(f"CAST({c} AS bigint) AS {c}" for c in longs), f"CAST({covered} AS bigint) AS n_repeat_words")


def lines_of(docs: DataFrame) -> DataFrame:
    """(host, key, doc_id): the hash of each line that has a word, with its host."""
    d = docs.select("doc_id", F.col("source").alias("host"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return d.where(f"{_CHARS('line')} > 0").selectExpr("host", f"{_KEY('host', 'line')} AS key", "doc_id")


def clean(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, the text without its frequent lines, with n_frequent_lines, their number. The other lines
    stay in order, blank ones too."""
    lines = lines_of(docs)
    each = lines.groupBy("key", "doc_id").agg(F.min("host").alias("host"))
    often = each.groupBy("key").agg(F.count("*").alias("docs"), F.min("host").alias("host")).where(F.col("docs") >= MIN_DOCS)
    hosts = docs.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("host_docs"))
    often = often.join(hosts, F.col("docs").isNotNull() & often["host"].eqNullSafe(hosts["host"])).where(F.col("docs") > SHARE * F.col("host_docs"))
    drop = lines.join(often.select("key"), "key").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("_keys"))
    out = docs.join(drop, docs["doc_id"].eqNullSafe(F.col("_id")), "left").drop("_id")
    kept = f"filter(split(text, '\\n'), x -> {_CHARS('x')} = 0 OR NOT array_contains(_keys, {_KEY('source', 'x')}))"
    out = out.withColumn("_lines", F.expr(f"IF(_keys IS NULL, NULL, {kept})"))
    gone = F.expr("CAST(IF(_keys IS NULL OR text IS NULL, 0, size(split(text, '\\n')) - size(_lines)) AS bigint)")
    text = F.expr("IF(_keys IS NULL, text, array_join(_lines, '\n'))")
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != "n_frequent_lines"]
    return out.select(*cols, gone.alias("n_frequent_lines"))


def line_loss(docs: DataFrame) -> DataFrame:
    """(doc_id, lost, n_frequent_lines): the share of each document's word characters that went with its frequent lines."""
    d = docs.select("doc_id", "source", "text", F.expr(f"CAST({_CHARS('text')} AS bigint)").alias("chars"))
    d = clean(d).select("doc_id", "chars", F.expr(f"CAST({_CHARS('text')} AS bigint)").alias("left"), "n_frequent_lines")
    lost = F.try_divide(F.sum("chars") - F.sum("left"), F.sum("chars"))
    return d.groupBy("doc_id").agg(lost.alias("lost"), F.sum("n_frequent_lines").alias("n_frequent_lines"))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics with base_failed, lost and kept."""
    s, loss = statistics(docs), line_loss(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = s.join(loss.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    lost = F.coalesce("lost", F.lit(0.0))
    return out.select(*s.columns, failed.alias("base_failed"), (~failed & (lost <= 1 - KEEP)).alias("kept"), F.coalesce("n_frequent_lines", F.lit(0)).cast("long").alias("n_frequent_lines"))


def oracle() -> str:
    space = r"[ \t\n\x0B\f\r]"
    return rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS w,
             length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS l FROM d),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o AS e
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE e IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r WHERE n > 1) GROUP BY doc_id),
x AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
y AS (SELECT doc_id, host, length(regexp_replace(line, '{space}', '', 'g')) AS chars,
             trim(regexp_replace(lower(line), '[ \t\n\x0B\f\r0-9]+', ' ', 'g'), ' ') AS k FROM x),
z AS (SELECT * FROM y WHERE chars > 0),
f AS (SELECT host, k, count(DISTINCT doc_id) AS docs FROM z GROUP BY host, k),
h AS (SELECT source AS host, count(*) AS host_docs FROM documents GROUP BY source),
q AS (SELECT f.host, k FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host WHERE docs >= {MIN_DOCS} AND docs > {SHARE} * host_docs),
s AS (SELECT doc_id, CAST(sum(CASE WHEN q.k IS NULL THEN 0 ELSE chars END) AS DOUBLE) / sum(chars) AS lost, sum(CASE WHEN q.k IS NULL THEN 0 ELSE 1 END) AS n
      FROM z LEFT JOIN q ON z.host IS NOT DISTINCT FROM q.host AND z.k = q.k GROUP BY doc_id),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(lost, 0) AS lost, CAST(coalesce(s.n, 0) AS BIGINT) AS n_frequent_lines FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AND lost <= {1 - KEEP} AS kept, n_frequent_lines
FROM a"""
