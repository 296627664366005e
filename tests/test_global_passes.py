"""The passes over what the unit pass leaves, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from hashloom.operators import match as mt


def some(seed):
    rng = random.Random(seed)
    apps, libs = ["a1", "a2"], [f"l{i}" for i in range(9)]
    name = {lib: f"name{i % 4}" for i, lib in enumerate(libs)}
    lib_classes, class_methods = [], []
    for lib in libs:
        for k in range(rng.randint(1, 4)):
            lib_classes.append((lib, f"{lib}:{k}"))
            for _ in range(rng.randint(1, 5)):
                h = rng.randrange(14)
                class_methods.append((f"{lib}:{k}", f"m{h}", f"s{h % 11}"))
    of = defaultdict(list)
    for key, h, _ in class_methods:
        of[key].append(h)
    digest = lambda hs: "c" + ",".join(sorted(hs))
    classes, methods = [], []
    for app in apps:
        for p in range(4):
            for c in range(4):
                if rng.random() < 0.5:  # a copy of a library's class, or most of it
                    hs = list(of[rng.choice(lib_classes)[1]])
                    hs = hs if rng.random() < 0.4 else hs[: max(1, len(hs) - 1)]
                else:
                    hs = [f"m{rng.randrange(14)}" for _ in range(rng.randint(1, 4))]
                flags = rng.choice([1, 1, 1, 0x600, 0x401])
                classes.append((app, f"p{p}", f"C{c}", digest(hs) if rng.random() < 0.7 else "c?", flags, len(hs)))
                methods += [(app, f"p{p}", f"C{c}", i, h, f"s{int(h[1:]) % 11}", rng.choice([1, 1, 1, 0x1001])) for i, h in enumerate(hs)]
    index_class = [(digest(of[key]), lib) for lib, key in lib_classes]
    index_method = [(h, key.split(":")[0]) for key, h, _ in class_methods]
    return apps, name, lib_classes, class_methods, classes, methods, index_class, index_method


def plain(level, taken, found, data):
    apps, name, lib_classes, class_methods, classes, methods, index_class, index_method = data
    lists, simple = defaultdict(list), defaultdict(set)
    for key, h, s in class_methods:
        lists[key].append(h)
        simple[key].add(s)
    size = Counter(lib for lib, _ in lib_classes)
    out = set()
    for app in apps:
        left = [c for c in classes if c[0] == app and c[:3] not in taken]
        own = {c[:3]: [m for m in methods if m[:3] == c[:3]] for c in left}
        votes = Counter()
        for c in left:
            if c[5] <= 1 or (level == "method" and c[4] & 0x600):
                continue
            if level == "class":
                votes.update({lib: c[5] * n for lib, n in Counter(lib for h, lib in index_class if h == c[3]).items()})
            else:
                votes.update(lib for m in own[c[:3]] for h, lib in index_method if h == m[4])
        ranked, kept = sorted(votes, key=lambda x: (-votes[x], x)), Counter()
        short = [lib for lib in ranked if not (kept.update([name[lib]]) or kept[name[lib]] > 6)]
        gone, last, once = set(), "", False
        for lib in short:
            if once and last.endswith(name[lib]):
                continue
            last = name[lib]
            if (app, last) in found:
                continue
            used, mine = set(), set()
            for c in sorted(left):
                if c[4] & 0x600 or c[:3] in gone:
                    continue
                hit = {x for h, x in index_class if h == c[3]}
                if hit:
                    if lib in hit:
                        mine.add(c[:3])
                    continue
                told = [m for m in own[c[:3]] if not m[6] & 0x1440]
                shared = Counter(key for m in told for of, key in lib_classes if of == lib for h in lists[key] if h == m[4])
                for key in sorted(shared, key=lambda k: (-shared[k], k)):
                    if key in used or len(own[c[:3]]) > len(lists[key]):
                        continue
                    if sum(m[5] in simple[key] for m in told) / len(own[c[:3]]) > 0.9:
                        used.add(key)
                        mine.add(c[:3])
                        break
            if len(mine) / size[lib] > 0.2:
                once = True
                gone |= mine
                out |= {(app, lib, name[lib], len(mine), size[lib], c[1], c[2]) for c in mine}
    return out


@pytest.mark.parametrize("seed", range(5))
def test_passes_against_plain_loops(spark, seed):
    data = some(seed)
    apps, name, lib_classes, class_methods, classes, methods, index_class, index_method = data
    table = spark.createDataFrame
    nodes = {"classes": table(classes, "app_id string, package string, class_name string, hash string, access_flags int, n_methods long"), "methods": table(methods, "app_id string, package string, class_name string, method_idx int, hash string, simple_hash string, access_flags int")}
    index = {
        "index_class": table(index_class, "hash string, lib_hash string"),
        "index_method": table(index_method, "hash string, lib_hash string"),
        "lib_classes": table(lib_classes, "lib_hash string, class_key string"),
        "class_methods": table(class_methods, "class_key string, hash string, simple_hash string"),
        "libs": table(list(name.items()), "lib_hash string, name string"),
    }
    taken, found = {c[:3] for c in classes[:: 5 + seed]}, {("a1", "name1")}
    kinds = "app_id string, package string, class_name string", "app_id string, name string"
    for level in ("class", "method"):
        want = plain(level, taken, found, data)
        got = {tuple(r) for r in mt.global_pass(level, table(sorted(taken), kinds[0]), table(sorted(found), kinds[1]), nodes, index).collect()}
        assert got == want
        taken |= {(r[0], r[5], r[6]) for r in want}


def test_off_by_default_and_behind_a_flag(spark, sf_dir):
    from hashloom.operators import index as ix
    from hashloom.plans import programs
    from hashloom.plans.queries import _profile
    from pyspark.sql import functions as F

    profile = _profile(spark, sf_dir)
    own = profile["packages"].limit(3).select(F.concat_ws(":", "app_id", "package").alias("lib_hash"), "app_id", F.array("package").alias("packages"))
    own = spark.createDataFrame(own.collect(), own.schema)
    index = ix.build_index(programs.library_profile(own.select("lib_hash", "app_id"), own.select("lib_hash", "packages"), profile), own.select("lib_hash", F.col("lib_hash").alias("name")))
    plainly, more = programs.match(profile, index).collect(), programs.match(profile, index, passes=("class",)).collect()
    assert set(map(tuple, plainly)) <= set(map(tuple, more))
    assert all(r.unit_id == "[class]" for r in more if tuple(r) not in set(map(tuple, plainly)))
