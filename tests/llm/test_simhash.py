"""Fingerprints and near-duplicate groups against brute force."""

import itertools
import random
import re

import xxhash

from playtrail.llm import simhash
from playtrail.llm.shared import connected_components

SCHEMA = "doc_id bigint, text string, fp string, component string"


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(pairs):
    """Ids to the smallest id they are connected to."""
    found = [(i, slow_fingerprint(t)) for i, t in pairs]
    name = {i: i for i, _ in found}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(found, 2):
            if (a ^ b).bit_count() <= 2 and name[i] != name[j]:
                name[i] = name[j] = min(name[i], name[j])
                changed = True
    return name


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(40)]
    for base in list(texts[:12]):
        for _ in range(3):
            changed = base.split()
            changed[rng.randrange(len(changed))] = "new"
            texts.append(" ".join(changed))
    return [*enumerate(texts), (900, None), (901, ""), (902, " \t\n"), (903, texts[0]), (904, texts[0].upper()),
            (905, "É é 日本 " * 4000)]


def test_fingerprints_equal_brute_force():
    for _, text in corpus():
        assert simhash.fingerprints_of([text])[0] % (1 << 64) == slow_fingerprint(text)


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == slow_groups(rows)


def test_every_pair_within_two_bits_meets_in_a_table():
    masks = simhash.covering_masks()
    for bits in itertools.combinations(range(64), 2):
        assert any(not m >> bits[0] & 1 and not m >> bits[1] & 1 for m in masks)


def test_links_are_exact_in_small_and_large_buckets(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)}
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    want = slow_components(values)
    for pairwise in (0, 3, 1000):
        links = simhash.near_links(df, pairwise=pairwise)
        rows = links.collect()
        assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in rows)
        found = {r["node"] % (1 << 64): r["component"] for r in connected_components(links).collect()}
        groups = {}
        for v in values:
            groups.setdefault(found.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == want


def slow_components(values):
    left, groups = set(values), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            v = todo.pop()
            group.add(v)
            near = {o for o in left if (o ^ v).bit_count() <= 2}
            left -= near
            todo += near
        groups.append(sorted(group))
    return sorted(groups)


def test_one_document_of_each_group_stays(spark):
    rows = [*corpus(), (0, corpus()[0][1]), (7, "another text under a used id"), (None, "without id"), (None, "without id")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    names = slow_groups(corpus())
    want = [(False, i, t or "") for i, t in corpus() if names[i] == i]
    want += [(False, 7, "another text under a used id"), (True, 0, "without id")]
    assert got == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicate_groups(df).count() == 0
    assert simhash.keep_one_per_group(df).count() == 0
