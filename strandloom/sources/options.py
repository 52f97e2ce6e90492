"""Options of the stages and what is allowed for them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """check() names the first option of a stage that is out of range, as a ValueError.

    A tip length of 0 stands for the longest read."""

    prefix: str
    config: str
    k: int
    filter_size: int = 1 << 20
    window: int = 10
    longest_read: int = 250
    tip: int = 0
    least_cover: int = 3
    least_map: int = 5
    extend: int = 1000
    correct: bool = True

    @property
    def longest_tip(self) -> int:
        return self.tip or self.longest_read

    def check(self, stage: str) -> Options:
        rules = [("prefix", bool(self.prefix), "must be set"), ("config", bool(self.config), "must be set"), ("k", self.k > 1, "must be over 1")]
        if stage in ("preprocess", "count"):
            rules.append(("filter_size", self.filter_size >= 1 << 20, "must be 1048576 or more"))
        if stage == "preprocess":
            rules += [
                ("correct", self.correct, "must be true"),
                ("window", 1 <= self.window <= 20, "must be 1 to 20"),
                ("tip", self.tip == 0 or 2 * self.k <= self.tip <= self.longest_read, "must be 0 or from 2 k to the longest read"),
            ]
        if stage in ("simplify", "consensus"):
            rules += [
                ("window", 1 <= self.window <= 100, "must be 1 to 100"),
                ("longest_read", self.longest_read >= self.k + 50, "must be k + 50 or more"),
                ("least_map", 5 <= self.least_map < 20, "must be 5 to 19"),
            ]
        if stage == "consensus":
            rules += [("least_cover", 2 <= self.least_cover <= 10, "must be 2 to 10"), ("extend", self.extend >= 1000, "must be 1000 or more")]
        for name, ok, need in rules:
            if not ok:
                raise ValueError(f"{stage}: {name} {need}, and is {getattr(self, name)!r}")
        return self
