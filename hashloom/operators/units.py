"""Candidate units of an app: its package components, merged by name (GR-06..10, JN-10, JN-11).

Merging looks at what earlier merges made, so it is a fold. Its state is one
app's packages and never leaves that app, so apps are folded side by side.
Components are visited in the order of their smallest packages.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .edges import called
from .filters import TOP_LEVEL, is_top_level

UNITS = "app_id string, unit_id string, packages array<string>"


def _up(name: str, levels: int) -> str | None:
    parts = name.split(".")
    return ".".join(parts[:-levels]) if len(parts) > levels else None


def _depth(name: str) -> int:
    return name.count(".") + 1


def _is_family(packages: list[str]) -> bool:
    return packages[-1].startswith(packages[0] + ".")


class Fold:
    """The components of one app while they are merged.

    Components are numbered by their smallest package and keep their numbers,
    and are visited in that order. A package's number is what lookups go by;
    after the first step that is not brought up to date for the packages of a
    component that merges, but for its first one, so lookups by the others
    find a component that is gone.
    """

    def __init__(self, components: Iterable[Iterable[str]], alone: Iterable[str], called: Iterable[str]):
        own = sorted(sorted(c) for c in [*components, *([p] for p in alone)])
        self.members = dict(enumerate(own))
        self.of = {p: k for k, packages in self.members.items() for p in packages}
        self.called = set(called) - set(alone)
        self.single = {k for k, packages in self.members.items() if len(packages) == 1}

    def merge(self, gone: int, into: int) -> None:
        own = self.members.pop(gone)
        self.members[into] = sorted({*own, *self.members[into]})
        self.of[own[0]] = into
        self.single.discard(gone)

    def largest(self, ids: Iterable[int]) -> int | None:
        """The component with most packages, the first of equals, of those that are there."""
        return min((c for c in ids if c in self.members), key=lambda c: (-len(self.members[c]), c), default=None)

    def into_parents(self) -> None:
        """Singletons join their children's largest component, then the nearest of three ancestors (GR-09)."""
        below: dict[str, set[int]] = {}
        for p, k in self.of.items():
            if k not in self.single and (above := _up(p, 1)):
                below.setdefault(above, set()).add(k)
        for c in sorted(self.single):
            into = self.largest(below.get(self.members[c][0], ()))
            if into is not None:
                self.merge(c, into)
        for c in sorted(self.single):
            for levels in (1, 2, 3):
                above = _up(self.members[c][0], levels)
                if above is None or above in TOP_LEVEL:
                    break
                if above in self.of:
                    if self.of[above] in self.members:
                        self.merge(c, self.of[above])
                    break

    def uncalled(self) -> list[int]:
        """Components that nothing calls (GR-08)."""
        return sorted(c for c, own in self.members.items() if not self.called & set(own))

    def into_siblings(self) -> None:
        """Uncalled components join their first package's parent, then the largest near relation (GR-10).

        Near are the components of the children of the first package's parent
        and grandparent, other than itself. The largest is chosen first; if it
        is the component's own, or is called and a family, nothing happens.
        """
        uncalled = self.uncalled()
        for c in uncalled:
            above = _up(self.members[c][0], 1)
            if above is not None and above not in TOP_LEVEL and self.of.get(above) in self.members:
                self.merge(c, self.of[above])
        for c in [c for c in uncalled if c in self.members]:
            own = self.members[c]
            if c not in self.single and _is_family(own) and _depth(own[0]) <= 3:
                continue
            parent, grandparent = _up(own[0], 1), _up(own[0], 2)
            if parent is None or parent in TOP_LEVEL:
                continue
            roots = {parent} if grandparent is None or grandparent in TOP_LEVEL else {parent, grandparent}
            into = self.largest(self.of[p] for p in self.of if p != own[0] and _up(p, 1) in roots)
            if into is None or into == c or (into not in uncalled and _is_family(self.members[into])):
                continue
            self.merge(c, into)

    def units(self) -> list[list[str]]:
        return sorted(self.members.values())


def recover(components: Iterable[Iterable[str]], alone: Iterable[str], called: Iterable[str]) -> list[list[str]]:
    """The units of one app."""
    fold = Fold(components, alone, called)
    fold.into_parents()
    fold.into_siblings()
    return fold.units()


def by_third_level(packages: list[str]) -> list[list[str]]:
    """A unit split by the first three segments of its names: the default split of large units."""
    out: dict[str, list[str]] = {}
    for p in packages:
        out.setdefault(".".join(p.split(".")[:3]), []).append(p)
    return [out[k] for k in sorted(out)]


def candidate_units(packages: DataFrame, classified: DataFrame, apps: DataFrame, split=None, split_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """UNITS of packages (app_id, package), classified edges and apps (app_id, package_name).

    split cuts units whose first package begins with one of split_prefixes.
    """
    key = lambda p: F.concat("app_id", F.lit("\0"), p)
    kept = classified.filter("keep")
    parts = connected_components(kept.select(key("src").alias("a"), key("dst").alias("b")))
    of = parts.select(F.split("node", "\0")[0].alias("app_id"), F.split("node", "\0")[1].alias("package"), F.split("component", "\0")[1].alias("component"))
    hit = called(classified).withColumn("called", F.lit(True))
    rows = packages.select("app_id", "package").distinct().join(of, ["app_id", "package"], "left").join(hit, ["app_id", "package"], "left")
    own = F.array_join(F.slice(F.split("package_name", r"\."), 1, 2), ".")
    rows = rows.join(apps.select("app_id", own.alias("own")), "app_id").filter("package <> '' AND NOT startswith(package, own)").filter(~is_top_level(F.col("package")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf[pdf.component.notna()]
        found = recover([g.package.tolist() for _, g in inside.groupby("component")], pdf[pdf.component.isna()].package, pdf[pdf.called.notna()].package)
        if split:
            found = [u for own in found for u in (split(own) if own[0].startswith(split_prefixes) else [own])]
        return pd.DataFrame({"app_id": pdf.app_id.iloc[0], "unit_id": [u[0] for u in found], "packages": found})

    return rows.groupBy("app_id").applyInPandas(fold, UNITS)
