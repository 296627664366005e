"""Finding known components: votes, shortlist, verification, report (JN-02..08, AGG-13, AGG-19, TOP-01..07)."""

from __future__ import annotations

from collections import Counter
from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.flags import candidate_class, candidate_method
from ..storage import CELL, dealt_join, materialize, sized
from .filters import named

#: Versions of one name that are verified, and the least shares of a class, of a library, and of a unit for stopping.
VERSIONS, CLASS_SHARE, LIB_SHARE, UNIT_SHARE = 6, 0.7, 0.2, 0.9

#: Pairs that the classes of a unit and of a library may make; where they may make more, the fold looks through the library.
MOST_PAIRS = 1_000_000


def vote_cascade(levels: list[DataFrame], indexes: list[DataFrame], keys: list[list[str]], unit: list[str], once: list[str] | None = None) -> DataFrame:
    """unit, lib_hash, votes (JN-02..04, AGG-13).

    levels run from coarse to fine; level i has columns unit, keys[i], hash,
    weight, and keys[i] begin with keys[i - 1]. Rows below a hit do not vote.
    Postings are bags, and are counted before rows meet them. once, if given, are
    the columns within which a hash of the last level votes once only, for the
    first of its rows by unit and keys. Rows whose hash has no posting go first,
    by a broadcast of the hashes where they are few, so that only the others are
    shuffled.
    """
    votes, hits = None, []
    for i, (rows, index) in enumerate(zip(levels, indexes, strict=True)):
        posted = materialize(index.groupBy("hash", "lib_hash").agg(F.count("*").alias("postings")), "posted")
        rows = rows.join(sized(posted.select("hash").distinct()), "hash", "left_semi")
        for above, k in hits:
            rows = rows.join(above, k, "left_anti")
        k = list(dict.fromkeys([*unit, *keys[i]]))
        if once is not None and i == len(levels) - 1:
            rows = rows.groupBy(*once, "hash").agg(F.min(F.struct(*[c for c in k if c not in once], "weight")).alias("r")).select(*once, "hash", "r.*")
        found = rows.join(sized(posted), "hash").groupBy(*k, "lib_hash").agg(F.sum(F.col("weight") * F.col("postings")).alias("weight"))
        if i < len(levels) - 1:  # written, as the levels below ask what was hit
            found = materialize(found, "hits")
            hits.append((sized(materialize(found.select(*k).distinct(), "above")), k))
        found = found.select(*unit, "lib_hash", "weight")
        votes = found if votes is None else votes.unionByName(found)
    return votes.groupBy(*unit, "lib_hash").agg(F.sum("weight").alias("votes"))


def unit_votes(units: DataFrame, nodes: dict[str, DataFrame], index: dict[str, DataFrame]) -> DataFrame:
    """app_id, unit_id, lib_hash, votes of units (app_id, unit_id, packages)."""
    of = units.select("app_id", "unit_id", F.explode("packages").alias("package"))
    p = nodes["packages"].join(of, ["app_id", "package"]).select("app_id", "unit_id", "package", "hash", F.col("n_methods").alias("weight"))
    c = nodes["classes"].filter(candidate_class(F.col("access_flags"), F.col("class_name"))).join(of, ["app_id", "package"])
    m = nodes["methods"].join(c.select("app_id", "unit_id", "package", "class_name"), ["app_id", "package", "class_name"]).select("app_id", "unit_id", "package", "class_name", "hash", F.lit(1).cast("long").alias("weight"))
    c = c.select("app_id", "unit_id", "package", "class_name", "hash", F.col("n_methods").alias("weight"))
    keys = [["package"], ["package", "class_name"], ["package", "class_name"]]
    return vote_cascade([p, c, m], [index["index_package"], index["index_class"], index["index_method"]], keys, ["app_id", "unit_id"], ["app_id"])


def shortlist(votes: DataFrame, libs: DataFrame, unit: list[str], versions: int = VERSIONS) -> DataFrame:
    """unit, lib_hash, name, votes, rk: the best versions of each name (JN-05, TOP-01..03), ties by lib_hash."""
    best = W.partitionBy(*unit, "name").orderBy(F.desc("votes"), "lib_hash")
    kept = named(votes, libs).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= versions).drop("at")
    return kept.withColumn("rk", F.row_number().over(W.partitionBy(*unit).orderBy(F.desc("votes"), "lib_hash")))


def overlap(left: DataFrame, right: DataFrame, a: str, b: str, element: str) -> DataFrame:
    """a, b, shared: how many elements pairs have in common, as bags (JN-07, SET-04)."""
    return left.join(right, element).groupBy(a, b).agg(F.count("*").alias("shared"))


def containment(left: DataFrame, right: DataFrame, a: str, b: str, element: str, least: float, where: Column | None = None) -> DataFrame:
    """a, b, shared, ratio: the share of a's distinct elements that b has, at least least (JN-08, AGG-19).

    If b has that share, it has one of a's rarest elements: the first of so
    many that the rest alone would not do. Only pairs that share one of those
    are counted, so that common elements make no pairs of their own. where may
    restrict the pairs.
    """
    df = right.groupBy(element).agg(F.count("*").alias("df"))
    of = W.partitionBy(a)
    ranked = left.join(df, element, "left").select(a, element, "df", F.count("*").over(of).alias("size"), F.row_number().over(of.orderBy(F.coalesce("df", F.lit(0)), element)).alias("at"))
    ranked = materialize(ranked, "ranked")
    size = ranked.filter("at = 1").select(a, "size")
    rare = ranked.filter((F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1) & F.col("df").isNotNull())
    pairs = rare.select(a, element).join(right, element)
    pairs = (pairs.filter(where) if where is not None else pairs).select(a, b).distinct()
    both = pairs.join(left, a).join(right, [b, element]).groupBy(a, b).agg(F.count("*").alias("shared")).join(size, a)
    return both.withColumn("ratio", F.col("shared") / F.col("size")).filter(F.col("ratio") >= least).drop("size")


def contained(rows: DataFrame, key: str, elements: str, least: float, lot: int = CELL) -> DataFrame:
    """a, b, shared, ratio: containment among the sets of one table, whose rows have a key and an array of binary digests.

    Rows of one key are one set. Equal sets are one node, up to lot keys each,
    and elements that no other node has only count. A node's postings carry its
    set, rarest first, and its keys, so that a pair is verified and expanded
    where it is found, at the first rare element that both have: what is
    shuffled grows with the rows and not with the pairs.
    """
    met = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_distinct(F.flatten(F.collect_list(elements))).alias("own"))
    same = F.md5(F.array_join(F.transform(F.sort_array("own"), F.hex), ","))
    sets = materialize(met.filter(F.size("own") > 0).select("key", same.alias("same"), F.size("own").alias("n"), "own"), "sets")
    big = materialize(sets.groupBy("same").agg(F.count("*").alias("many")).filter(F.col("many") > lot), "big")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("many", F.lit(1)) / lot)).alias("part")
    lots = sets.select("key", "same", "n").join(sized(big), "same", "left").groupBy("same", "n", part).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    lots = materialize(lots.select(F.col("keys")[0].alias("key"), "n", "keys"), "lots")
    one = sets.join(lots.select("key"), "key", "left_semi").select("key", F.explode("own").alias("digest"))
    common = one.groupBy("digest").agg(F.count("*").alias("df")).filter("df > 1")
    common = materialize(common.withColumn("e", F.monotonically_increasing_id()), "common")
    ranked = one.join(sized(common), "digest").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "e")))["e"].alias("es"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9)).cast("int")
    nodes = materialize(ranked.join(lots, "key").select("keys", "n", "es", need.alias("need")), "nodes")
    rare = nodes.filter(F.size("es") >= F.col("need")).withColumn("e", F.explode(F.slice("es", 1, F.size("es") - F.col("need") + 1)))
    rare = materialize(rare.select("e", F.col("keys").alias("as"), "n", "need", F.col("es").alias("mine")), "rare")
    posted = nodes.select(F.explode("es").alias("e"), F.col("keys").alias("bs"), F.col("es").alias("theirs"))
    posted = materialize(posted.join(sized(materialize(rare.select("e").distinct(), "wanted")), "e", "left_semi"), "posted")
    found = dealt_join(rare, posted, ["e"]).filter((F.size("theirs") >= F.col("need")) & (F.col("as")[0] != F.col("bs")[0]))
    found = found.select("as", "bs", "n", "e", F.array_intersect("mine", "theirs").alias("both")).filter("both[0] = e")
    found = found.select("as", "bs", F.size("both").cast("long").alias("shared"), "n")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = lots.filter(F.size("keys") > 1).select(F.explode("keys").alias("a"), "keys", "n").repartition(parts, "a")
    alike = alike.select(F.array("a").alias("as"), F.col("keys").alias("bs"), F.col("n").cast("long").alias("shared"), "n")
    pairs = found.unionByName(alike).withColumn("ratio", F.col("shared") / F.col("n")).filter(F.col("ratio") >= least)
    pairs = pairs.select(F.explode("as").alias("a"), "bs", "shared", "ratio").select("a", F.explode("bs").alias("b"), "shared", "ratio")
    return pairs.filter("a <> b")


def class_overlaps(candidates: DataFrame, units: DataFrame, nodes: dict[str, DataFrame], index: dict[str, DataFrame], share: float = CLASS_SHARE, above: bool = False) -> DataFrame:
    """app_id, unit_id, lib_hash, package, class_name, class_key, shared: verified pairs of app and library classes.

    A library class qualifies with at least as many methods, and with the
    simple hashes of that share of the app class's methods, or of more than
    that if above is set; the share's
    divisor counts all methods, its dividend those that candidate_method lets
    through.
    """
    of = units.select("app_id", "unit_id", F.explode("packages").alias("package"))
    own = nodes["methods"].join(of, ["app_id", "package"])
    cls = ["app_id", "unit_id", "package", "class_name"]
    lib = index["lib_classes"].join(index["class_methods"], "class_key")
    wanted = candidates.select("app_id", "unit_id", "lib_hash")
    eligible = own.filter(candidate_method(F.col("access_flags")))
    shared = eligible.select(*cls, "hash").join(wanted, ["app_id", "unit_id"]).join(lib.select("lib_hash", "class_key", "hash"), ["lib_hash", "hash"]).groupBy(*cls, "lib_hash", "class_key").agg(F.count("*").alias("shared"))
    n_own = own.groupBy(*cls).agg(F.count("*").alias("n_own"))
    n_lib = lib.groupBy("class_key").agg(F.count("*").alias("n_lib"), F.collect_set("simple_hash").alias("simple"))
    pairs = shared.join(n_own, cls).join(n_lib, "class_key").filter("n_lib >= n_own")
    mine = eligible.groupBy(*cls).agg(F.collect_list("simple_hash").alias("mine"))
    pairs = pairs.join(mine, cls).withColumn("both", F.size(F.filter("mine", lambda s: F.array_contains("simple", s))))
    ratio = F.col("both") / F.col("n_own")
    return pairs.filter(ratio > share if above else ratio >= share).select(*cls, "lib_hash", "class_key", "shared")


REPORT = "app_id string, unit_id string, lib_hash string, name string, matched long, classes long, fully boolean"


MATCHED = "app_id string, package string"


def report_app(rows: pd.DataFrame) -> pd.DataFrame:
    """REPORT rows of one app."""
    return _fold_app(rows)[0]


def matched_app(rows: pd.DataFrame) -> pd.DataFrame:
    """MATCHED rows of one app: the packages that its libraries have taken."""
    return _fold_app(rows)[1]


def _take(best: list[list[tuple[int, str]]], places: dict[str, list[int]], taken: Counter) -> bool:
    """Take the first free library class of the best kinds; best has heaps of (place, class_key), the best last."""
    while best:
        heap = best[-1]
        while heap:
            place, key = heap[0]
            if taken[key] == len(places[key]):
                heappop(heap)
            elif (now := places[key][taken[key]]) != place:  # taken for another class
                heapreplace(heap, (now, key))
            else:
                taken[key] += 1
                return True
        best.pop()
    return False


#: The next place of a library class of which none is left.
GONE = np.iinfo(np.int64).max


class _Posted:
    """Which rows of lists have a value, and how often; values that many rows have are rows of their own as well."""

    def __init__(self, lists: list[np.ndarray]):
        values = np.concatenate([np.asarray(x, "int64") for x in lists]) if lists else np.empty(0, "int64")
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.lexsort((at, values))
        values, at = values[order], at[order]
        new = np.flatnonzero(np.diff(values, prepend=values[:1] - 1) | np.diff(at, prepend=at[:1]))
        self.n = np.diff(new, append=len(values))
        values, self.at = values[new], at[new]
        own, starts = np.unique(values, return_index=True)
        self.of = dict(zip(own.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True), strict=True))
        self.hot: dict[int, np.ndarray] = {}
        for v, (a, b) in self.of.items():
            if b - a > len(lists) / 32:
                self.hot[v] = np.zeros(len(lists), bool)
                self.hot[v][self.at[a:b]] = True


class _Library:
    """The kinds of classes of one library, from which an app's classes take one after the other.

    rows: class_key, places, shared (its methods), hashes (a bag), simples (a
    set). Only classes that share a hash are looked at, and nothing that is
    found is kept, so that memory grows with the library and not with pairs.
    """

    def __init__(self, rows: pd.DataFrame):
        self.places = [np.sort(np.asarray(p, "int64")) for p in rows.places]
        self.methods = rows.shared.to_numpy("int64")
        self.hashes, self.simples = _Posted(list(rows.hashes)), _Posted(list(rows.simples))
        self.shared, self.mark = np.zeros(len(rows), "int64"), np.zeros(len(rows), bool)
        self.begin()

    def begin(self) -> None:
        """All classes are free again."""
        self.next, self.taken = np.array([p[0] for p in self.places], "int64"), Counter()
        self.left = sum(map(len, self.places))

    def take(self, n_own: int, hashes: np.ndarray, simples: np.ndarray) -> bool:
        """Take the free class that shares most with a class of n_own methods, the first of those alike; whether there is one."""
        met = []
        for h, n in Counter(hashes.tolist()).items():
            if h in self.hashes.of:
                a, b = self.hashes.of[h]
                self.shared[self.hashes.at[a:b]] += n * self.hashes.n[a:b]
                met.append(self.hashes.at[a:b])
        if not met:
            return False
        all_met = np.concatenate(met)
        at = all_met[(self.next[all_met] < GONE) & (self.methods[all_met] >= n_own)]
        shared = self.shared[at]
        self.shared[all_met] = 0
        both = np.zeros(len(at), "int64")
        for s, n in Counter(simples.tolist()).items() if len(at) else ():
            if s in self.simples.hot:
                both += n * self.simples.hot[s][at]
            elif s in self.simples.of:
                a, b = self.simples.of[s]
                self.mark[self.simples.at[a:b]] = True
                both += n * self.mark[at]
                self.mark[self.simples.at[a:b]] = False
        fit = both / n_own >= CLASS_SHARE
        at, shared = at[fit], shared[fit]
        if not len(at):
            return False
        best = at[shared == shared.max()]
        one = int(best[np.argmin(self.next[best])])
        self.taken[one] += 1
        self.left -= 1
        self.next[one] = self.places[one][self.taken[one]] if self.taken[one] < len(self.places[one]) else GONE
        return True


def _fold_app(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The libraries found in one app: a fold over its units, then its shortlist, in order.

    rows has kind, and by kind: unit (unit_id, package, class_name): a class of a
    unit; package and class: hits of a lib; pair: a verified pair with shared;
    candidate: name, rk, classes. What one library matched is gone for the next.
    With places, a unit's row stands for the classes of its package at these
    places, and hits and pairs are its own; of a library the rows of kind key
    (lib_hash, class_key) do so. Where a unit has rows of kind own and a library
    of kind their, with hashes and simples, and their methods as shared, pairs
    are looked for class by class and not given.
    """
    rows = rows if "places" in rows else rows.assign(places=None)
    by = {k: g for k, g in rows.groupby("kind")}
    empty = rows.iloc[:0]
    get = lambda k: by.get(k, empty)
    placed: dict[str, dict[str, list[tuple[int, str]]]] = {}
    for r in get("unit").sort_values(["unit_id", "package", "class_name"]).itertuples():
        own = placed.setdefault(r.unit_id, {}).setdefault(r.package, [])
        own.extend((int(at), r.class_name) for at in ([len(own)] if r.places is None else r.places))
    classes = {u: {p: [k for _, k in sorted(cs)] for p, cs in packages.items()} for u, packages in placed.items()}
    package_hits = set(zip(get("package").package, get("package").lib_hash, strict=True))
    class_hits = set(zip(get("class").package, get("class").class_name, get("class").lib_hash, strict=True))
    pairs: dict[tuple, dict[int, list[str]]] = {}
    for r in get("pair").itertuples():
        pairs.setdefault((r.unit_id, r.lib_hash, r.package, r.class_name), {}).setdefault(r.shared, []).append(r.class_key)
    places = {key: [i] for i, key in enumerate(sorted(set(get("pair").class_key)))}
    places |= {r.class_key: [int(at) for at in r.places] for r in get("key").itertuples()}
    asked: dict[str, dict[tuple[str, str], tuple]] = {}
    for r in get("own").itertuples():
        asked.setdefault(r.unit_id, {})[r.package, r.class_name] = (int(r.shared), r.hashes, r.simples)
    wide = dict(iter(get("their").groupby("lib_hash")))
    made: dict[str, _Library] = {}
    done_packages, names, out = set(), set(), []
    candidates = get("candidate").sort_values(["unit_id", "rk"])
    for unit, own in candidates.groupby("unit_id", sort=True):
        packages = classes.get(unit, {})
        for c in own.itertuples():
            if c.name in names:
                continue
            matched, checked, taken = 0, set(), Counter()
            library, spent = None, set()
            if unit in asked and c.lib_hash in wide:
                library = made.get(c.lib_hash) or made.setdefault(c.lib_hash, _Library(wide[c.lib_hash]))
                library.begin()
            for p, cs in packages.items():
                if p in done_packages:
                    continue
                if (p, c.lib_hash) in package_hits:
                    matched += len(cs)
                    checked.add(p)
                    continue
                best: dict[str, list[list[tuple[int, str]]]] = {}
                for k in cs:
                    if (p, k, c.lib_hash) in class_hits:
                        matched += 1
                        continue
                    if library is not None:
                        if library.left and (p, k) not in spent:
                            if library.take(*asked[unit][p, k]):
                                matched += 1
                                checked.add(p)
                            else:  # what is free becomes less only
                                spent.add((p, k))
                        continue
                    if k not in best:
                        like = pairs.get((unit, c.lib_hash, p, k), {})
                        best[k] = [[(places[key][0], key) for key in like[n]] for n in sorted(like)]
                        for heap in best[k]:
                            heapify(heap)
                    if _take(best[k], places, taken):
                        matched += 1
                        checked.add(p)
            if c.classes and matched / c.classes >= LIB_SHARE:
                names.add(c.name)
                done_packages |= checked
                out.append((rows.app_id.iloc[0], unit, c.lib_hash, c.name, matched, int(c.classes), len(checked) == len(packages)))
                if packages and len(checked) / len(packages) >= UNIT_SHARE:
                    break
    gone = [(rows.app_id.iloc[0], p) for p in sorted(done_packages)]
    return pd.DataFrame(out, columns=[x.split()[0] for x in REPORT.split(", ")]), pd.DataFrame(gone, columns=[x.split()[0] for x in MATCHED.split(", ")])


def match_apps(units: DataFrame, nodes: dict[str, DataFrame], index: dict[str, DataFrame], most: int = MOST_PAIRS) -> DataFrame:
    """REPORT rows of all apps: votes and pairs are joins, the report a fold of each app."""
    return _told(units, nodes, index, most).groupBy("app_id").applyInPandas(report_app, REPORT)


def _listed(*parts: Column) -> Column:
    """A digest of the parts of all rows of a group, in whatever order they come."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.unhex(F.md5(F.concat_ws(",", *parts))))), F.hex), "")


def _first_of(rows: DataFrame, own: list[str], name: str, alike: list[str]) -> DataFrame:
    """own, alike, name, places: of the rows alike within own the first by name, and the places of all of them in own's order."""
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(*own).orderBy(name)))
    return placed.groupBy(*own, *alike).agg(F.min(name).alias(name), F.sort_array(F.collect_list("place")).alias("places"))


def _searched(wide: DataFrame, units: DataFrame, own: dict[str, DataFrame], lib: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of kind own and their for the fold, of the units and libraries of wide (app_id, unit_id, lib_hash).

    Hashes go as the numbers of those that the libraries have.
    """
    lib = lib.join(sized(materialize(wide.select("lib_hash").distinct(), "wanted")), "lib_hash", "left_semi")
    number = lambda c, to: sized(materialize(lib.filter(F.col(c).isNotNull()).select(c).distinct().withColumn(to, F.monotonically_increasing_id()), "numbers"))
    h, s = number("hash", "h"), number("simple_hash", "s")
    their = lib.join(h, "hash", "left").join(s, "simple_hash", "left").groupBy("lib_hash", "class_key")
    their = their.agg(F.count("*").alias("shared"), F.collect_list("h").alias("hashes"), F.collect_set("s").alias("simples"))
    their = their.join(keys.select("lib_hash", "class_key", "places"), ["lib_hash", "class_key"]).join(wide.select("app_id", "lib_hash").distinct(), "lib_hash")
    of = units.join(wide, ["app_id", "unit_id"], "left_semi").select("app_id", "unit_id", F.explode("packages").alias("package"))
    rows = own["methods"].join(sized(materialize(of, "wanted")), ["app_id", "package"]).join(h, "hash", "left").join(s, "simple_hash", "left")
    told = lambda c: F.collect_list(F.when(candidate_method(F.col("access_flags")), F.col(c)))
    rows = rows.groupBy("app_id", "unit_id", "package", "class_name").agg(F.count("*").alias("shared"), told("h").alias("hashes"), told("s").alias("simples"))
    return rows, their


def _told(units: DataFrame, nodes: dict[str, DataFrame], index: dict[str, DataFrame], most: int = MOST_PAIRS) -> DataFrame:
    """What the fold of an app goes by.

    Classes of a package, or of a library, whose methods are the same count as
    one: the first of them meets others, and the fold has the places of all.
    Pairs are joined where the classes of a unit and a library can make at most
    so many; where they can make more, the fold gets the classes of both.
    """
    votes = unit_votes(units, nodes, index)
    n_classes = index["lib_classes"].groupBy("lib_hash").agg(F.count("*").alias("classes"))
    best = materialize(shortlist(votes, index["libs"], ["app_id", "unit_id"]).join(n_classes, "lib_hash"), "best")
    of = units.select("app_id", "unit_id", F.explode("packages").alias("package"))
    package, cls = ["app_id", "package"], ["app_id", "package", "class_name"]
    hit = materialize(nodes["packages"].join(index["index_package"], "hash").select(*package, "lib_hash").distinct(), "hit")
    hit_packages = hit.select(*package).distinct().withColumn("whole", F.lit(True))
    c = nodes["classes"].join(of, package).join(hit_packages, package, "left")
    c = c.select("app_id", "unit_id", "package", "class_name", "hash", (F.col("whole").isNull() & candidate_class(F.col("access_flags"), F.col("class_name"))).alias("votes"))
    code = nodes["methods"].groupBy(*cls).agg(_listed(F.col("hash"), F.col("simple_hash"), candidate_method(F.col("access_flags")).cast("string")).alias("code"))
    alike = ["hash", "votes", "code"]
    first = c.join(code.select(*cls, F.md5("code").alias("code")), cls, "left")
    first = materialize(_first_of(first, ["app_id", "unit_id", "package"], "class_name", alike), "first")
    lib = index["lib_classes"].join(index["class_methods"], "class_key").groupBy("lib_hash", "class_key").agg(F.md5(_listed(F.col("hash"), F.col("simple_hash"))).alias("code"))
    keys = materialize(_first_of(lib, ["lib_hash"], "class_key", ["code"]), "keys")
    few, few_keys = sized(first.select(*cls)), sized(keys.select("class_key"))
    own = {"methods": materialize(nodes["methods"].join(few, cls, "left_semi"), "own")}
    theirs = {"lib_classes": keys.select("lib_hash", "class_key"), "class_methods": materialize(index["class_methods"].join(few_keys, "class_key", "left_semi"), "theirs")}
    wanted = best.select("app_id", "unit_id", "lib_hash")
    sizes = first.groupBy("app_id", "unit_id").agg(F.count("*").alias("mine")), keys.groupBy("lib_hash").agg(F.count("*").alias("theirs"))
    sizes = materialize(wanted.join(sizes[0], ["app_id", "unit_id"]).join(sizes[1], "lib_hash").withColumn("wide", F.col("mine") * F.col("theirs") > most), "sizes")
    narrow, wide = sizes.filter("NOT wide"), sizes.filter("wide")
    asking = {"lib_classes": theirs["lib_classes"].join(narrow, "lib_hash", "left_semi"), "class_methods": theirs["class_methods"]}
    pairs = materialize(class_overlaps(narrow, units.join(narrow, ["app_id", "unit_id"], "left_semi"), own, asking), "pairs")
    class_hit = first.filter("votes").join(index["index_class"].select("hash", "lib_hash").distinct(), "hash").join(wanted, ["app_id", "unit_id", "lib_hash"], "left_semi")
    met = pairs.select("app_id", "lib_hash", "class_key").distinct().join(keys, ["lib_hash", "class_key"])
    columns = {"unit_id": "string", "package": "string", "class_name": "string", "lib_hash": "string", "class_key": "string", "name": "string", "shared": "long", "rk": "int", "classes": "long", "places": "array<int>", "hashes": "array<long>", "simples": "array<long>"}

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select("app_id", F.lit(kind).alias("kind"), *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()])

    rows = tagged(first, "unit")
    searched = [] if wide.isEmpty() else zip(_searched(wide, units, own, theirs["lib_classes"].join(theirs["class_methods"], "class_key"), keys), ("own", "their"), strict=True)
    for df, kind in ((hit, "package"), (class_hit.drop("places"), "class"), (pairs, "pair"), (met, "key"), (best, "candidate"), *searched):
        rows = rows.unionByName(tagged(df, kind))
    return rows


#: The global passes' least shares of a class and of a library: both have to be exceeded.
GLOBAL_CLASS_SHARE, GLOBAL_LIB_SHARE = 0.9, 0.2
FOUND = "found"
GLOBAL = "app_id string, lib_hash string, name string, matched long, classes long, package string, class_name string"


def global_app(rows: pd.DataFrame) -> pd.DataFrame:
    """GLOBAL rows of one app in one pass: a row a class that a found library takes.

    rows has kind, and by kind: hit (package, class_name, lib_hash), a class
    whose hash libraries have; pair, a verified pair with shared; candidate:
    name, rk, classes, and FOUND as class_key if its name was found before. A
    class with hits counts for the libraries that it hits only. Once something
    is found, a candidate is passed over if the name before it ends in its own.
    """
    by = {k: g for k, g in rows.groupby("kind")}
    get = lambda k: by.get(k, rows.iloc[:0])
    hits: dict[tuple[str, str], set[str]] = {}
    for r in get("hit").itertuples():
        hits.setdefault((r.package, r.class_name), set()).add(r.lib_hash)
    pairs: dict[str, dict[tuple[str, str], list[str]]] = {}
    for r in get("pair").sort_values(["shared", "class_key"], ascending=[False, True]).itertuples():
        if (r.package, r.class_name) not in hits:
            pairs.setdefault(r.lib_hash, {}).setdefault((r.package, r.class_name), []).append(r.class_key)
    gone, out, name, once = set(), [], "", False
    for c in get("candidate").sort_values("rk").itertuples():
        if once and name.endswith(c.name):
            continue
        name, taken, mine = c.name, set(), []
        if c.class_key == FOUND:
            continue
        for k in sorted({k for k, libs in hits.items() if c.lib_hash in libs} | set(pairs.get(c.lib_hash, ()))):
            if k in gone:
                continue
            if k not in hits:
                key = next((x for x in pairs[c.lib_hash][k] if x not in taken), None)
                if key is None:
                    continue
                taken.add(key)
            mine.append(k)
        if c.classes and len(mine) / c.classes > GLOBAL_LIB_SHARE:
            once = True
            gone |= set(mine)
            out += [(rows.app_id.iloc[0], c.lib_hash, c.name, len(mine), int(c.classes), p, k) for p, k in mine]
    return pd.DataFrame(out, columns=[x.split()[0] for x in GLOBAL.split(", ")])


def global_pass(level: str, taken: DataFrame, found: DataFrame, nodes: dict[str, DataFrame], index: dict[str, DataFrame]) -> DataFrame:
    """GLOBAL rows of what libraries are found among the classes that nothing has taken yet (section 2.13 H).

    level is class or method: which hashes vote, those of all classes with
    more than one method, or of the methods of such classes that are neither
    interfaces nor abstract. taken: (app_id, package, class_name); found:
    (app_id, name), which are not looked for again.
    """
    cls = ["app_id", "package", "class_name"]
    left = materialize(nodes["classes"].join(taken.select(*cls).distinct(), cls, "left_anti"), "left")
    plain = left.filter(F.col("access_flags").bitwiseAND(0x600) == 0)
    if level == "class":
        votes = left.filter("n_methods > 1").join(index["index_class"], "hash").groupBy("app_id", "lib_hash").agg(F.sum("n_methods").alias("votes"))
    else:
        own = nodes["methods"].join(plain.filter("n_methods > 1").select(*cls), cls, "left_semi")
        votes = own.join(index["index_method"], "hash").groupBy("app_id", "lib_hash").agg(F.count("*").alias("votes"))
    n_classes = index["lib_classes"].groupBy("lib_hash").agg(F.count("*").alias("classes"))
    known = found.select("app_id", "name").distinct().withColumn("class_key", F.lit(FOUND))
    best = shortlist(votes, index["libs"], ["app_id"]).join(known, ["app_id", "name"], "left")
    best = materialize(best.join(n_classes, "lib_hash", "left").withColumn("unit_id", F.lit("")), "best")
    # all that is left of an app is one unit
    units = plain.groupBy("app_id").agg(F.collect_set("package").alias("packages")).withColumn("unit_id", F.lit(""))
    own = {"methods": nodes["methods"].join(plain.select(*cls), cls, "left_semi")}
    pairs = class_overlaps(best.filter("class_key IS NULL").select("app_id", "unit_id", "lib_hash"), units, own, index, GLOBAL_CLASS_SHARE, above=True)
    hits = plain.join(index["index_class"], "hash").select(*cls, "lib_hash").distinct()
    columns = {"package": "string", "class_name": "string", "lib_hash": "string", "class_key": "string", "name": "string", "shared": "long", "rk": "int", "classes": "long"}

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select("app_id", F.lit(kind).alias("kind"), *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()])

    rows = tagged(hits, "hit").unionByName(tagged(pairs, "pair")).unionByName(tagged(best, "candidate"))
    return rows.groupBy("app_id").applyInPandas(global_app, GLOBAL)


def match_globally(units: DataFrame, nodes: dict[str, DataFrame], index: dict[str, DataFrame], passes: tuple[str, ...] = ("class", "method")) -> DataFrame:
    """REPORT rows of match_apps, and those of the passes over what it leaves, whose unit_id is the pass's name in brackets.

    Each pass leaves out the classes that those before have taken and the
    names that they have found.
    """
    told = materialize(_told(units, nodes, index), "told")
    report = materialize(told.groupBy("app_id").applyInPandas(report_app, REPORT), "report")
    taken = told.groupBy("app_id").applyInPandas(matched_app, MATCHED).join(nodes["classes"], ["app_id", "package"])
    taken = materialize(taken.select("app_id", "package", "class_name"), "taken")
    for level in passes:
        more = materialize(global_pass(level, taken, report, nodes, index), "global")
        lines = more.groupBy("app_id", "lib_hash", "name", "matched", "classes").agg(F.lit(f"[{level}]").alias("unit_id"))
        report = report.unionByName(lines.withColumn("fully", F.lit(False)).select(report.columns))
        taken = taken.unionByName(more.select(*taken.columns))
    return report




def exact_units(unit_hashes: DataFrame, libs: DataFrame) -> DataFrame:
    """Units whose hash is a library's: the optional exact pass, off in match_apps."""
    return unit_hashes.join(libs.withColumnRenamed("lib_hash", "unit_hash"), "unit_hash")


def first_app(candidates: DataFrame, hashes: DataFrame) -> DataFrame:
    """lib_hash, app_id: the first app by pos that reproduces each library's hash (JN-13).

    candidates: (lib_hash, app_id, pos); hashes: (app_id, lib_hash, hash) as recomputed from the app.
    """
    ok = candidates.join(hashes, ["lib_hash", "app_id"]).filter("hash = lib_hash")
    return ok.groupBy("lib_hash").agg(F.min_by("app_id", F.struct("pos", "app_id")).alias("app_id"))
