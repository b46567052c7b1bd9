"""SimHash and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from linkgraph.llm import simhash
from linkgraph.llm.components import connected_components

TEXTS = [None, "", " \t\n", "One", "one two three", "a b c d", "A  b\tc\x0bd", "x y z w v", "Ünï code İ words here", "same " * 500]


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_wide_print(text):
    """256 bits, four words mixed from each distinct shingle's hash."""
    full = (1 << 64) - 1
    ones, found = [0] * 256, {xxhash.xxh64_intdigest(g.encode(), seed=42) for g in shingles(text)}
    for h in found:
        for w in range(4):
            x = (h + 0x9E3779B97F4A7C15 * w) & full
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
            x = (x ^ x >> 27) * 0x94D049BB133111EB & full
            x ^= x >> 31
            for b in range(64):
                ones[64 * w + b] += x >> b & 1
    return sum(1 << b for b in range(256) if 2 * ones[b] > len(found))


def brute_components(prints, threshold=4):
    """index -> least index that is reachable."""
    found = list(range(len(prints)))

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = root(i), root(j)
                found[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_print(text)


@pytest.mark.parametrize("text", TEXTS)
def test_wide_fingerprint(text):
    got = simhash.wide_fingerprint(text.encode() if text is not None else None)
    assert int.from_bytes(got, "little") == brute_wide_print(text)


@pytest.mark.parametrize("cell", [4096, 16])
def test_wide_links(spark, cell):
    """All pairs within 32 bits meet for certain; the components are those of brute force."""
    rng = np.random.default_rng(4)
    prints = [int.from_bytes(rng.bytes(32), "little") for _ in range(120)]
    for k, apart in enumerate([1, 12, 25, 32, 32, 32, 32, 45, 60] * 6):
        x = prints[k]
        for b in rng.choice(253, apart, replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    df = spark.createDataFrame([(bytearray(x.to_bytes(32, "little")),) for x in prints], "fp binary")
    ids = {r.id: int.from_bytes(r.fp, "little") for r in df.selectExpr("fp", "xxhash64(fp) as id").collect()}
    linked = {}
    for r in simhash.link_wide_fingerprints(df, 32, cell).collect():
        linked.setdefault(r.component, set()).add(ids[r.node])
    want = {}
    for x, root in zip(prints, brute_components(prints, 32), strict=True):
        want.setdefault(root, set()).add(x)
    assert {frozenset(g) for g in linked.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_pairs_four_bits_apart_inside_the_code(spark):
    """All four differing bits among the 23 that the anchors cover, and copies of other anchors about."""
    rng = np.random.default_rng(12)
    prints = []
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(23, 4, replace=False):
            y ^= 1 << int(b)
        prints += [x, y]
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {r.node: r.component for r in simhash.link_fingerprints(df, 4, (simhash.GOLAY,)).collect()}
    assert all(got[x] == got[y] for x, y in zip(prints[::2], prints[1::2], strict=True))


def test_long_texts_and_names(docs):
    long = "word " * 400_000 + "end"
    rows = [(1, long), (2, long.upper()), (3, None)]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_digest(docs(rows)).collect()}
    assert got == {1: (brute_print(long), 1), 2: (brute_print(long), 1), 3: (0, 3)}
    clash = docs([(1, "a b", "x")], "doc_id long, text string, fp string")
    with pytest.raises(ValueError):
        simhash.near_duplicates(clash, keep=("fp",))
    assert simhash.near_duplicates(clash, keep=("doc_id",)).count() == 1


@pytest.mark.parametrize("code", [(simhash.HAMMING,), (simhash.GOLAY,)])
def test_code_is_perfect(code):
    words, weight, first, upto, low, high = simhash._cosets(code[0], code[0][2])
    assert (upto[:, -1] == 1).all()  # each coset has one leader within the radius


def near_prints(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    out = [int(x) for x in base]
    for i in range(0, n, 2):
        x = out[i]
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return list(dict.fromkeys(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(
    ("code", "n", "cell"), [((simhash.GOLAY,), 600, 4096), ((simhash.GOLAY,), 400, 8), ((simhash.GOLAY, simhash.GOLAY), 120, 64), ((simhash.HAMMING, simhash.HAMMING), 200, 4096)]
)
def test_links_equal_brute_force(spark, code, n, cell):
    prints = near_prints(n)
    want = brute_components(prints)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {r.node: r.component for r in simhash.link_fingerprints(df, 4, code, cell).collect()}
    groups = {}
    for x, w in zip(prints, want, strict=True):
        groups.setdefault(w, set()).add(signed(x))
    linked = {}
    for node, comp in got.items():
        linked.setdefault(comp, set()).add(node)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in linked.values()}
    assert all(min(g) == c for c, g in linked.items())


def test_digest_equals_brute_force(docs, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(5000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(None, "a b c d"), (7, rows[3][1]), (None, "only null reaches this row of words")]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    ids = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    want = sorted(((i, f"{p:016x}", ids.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=str)
    got = simhash.simhash_digest(docs(rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_empty_table(docs):
    assert simhash.simhash_digest(docs([])).count() == 0
    assert simhash.keep_one_of_each(docs([])).count() == 0


def test_keep_one_of_each(docs):
    long = "every word of this text is there to make it long enough for a stable print " * 5
    rows = [(3, long, "x"), (2, long, "y"), (2, long, "y"), (None, long, "z"), (9, "other words stand here", "a"), (8, None, "b"), (None, "", "c")]
    df = docs(rows, "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in simhash.keep_one_of_each(df).collect())
    assert got == [(2, long, "y"), (8, None, "b"), (9, "other words stand here", "a")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3), (500, 400), (400, -5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90, 500: -5, 400: -5, -5: -5}
