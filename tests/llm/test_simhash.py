"""SimHash by anchor covering against a plain computation over all pairs."""

import random
import re

from xxhash import xxh64_intdigest

from veilspark.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    seen = list(dict.fromkeys(prints.values()))
    root = {p: p for p in seen}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(seen):
        for q in seen[:i]:
            if bin(p ^ q).count("1") <= 3:
                root[find(p)] = find(q)
    least = {}
    for doc, p in prints.items():
        least[find(p)] = min(doc, least.get(find(p), doc))
    return {doc: least[find(p)] for doc, p in prints.items()}


def test_whole_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {d: plain(t) for d, t in texts.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    groups = plain_groups(prints)
    assert got == {d: (f"{prints[d]:016x}", groups[d]) for d in texts}


def test_links_are_whole_for_any_three_bits(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 2, 3, 4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(base + near)]
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(min(x, y), max(x, y)) for i, x in enumerate(signed) for y in signed[:i] if bin((x ^ y) & mask).count("1") <= 3}
    assert got == want and len(want) > 100


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (4, "A"), (None, "a"), (5, "x y z w"), (6, "word " * 70000)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.component_id) for r in got}
    assert by == {(1, 1), (2, 1), (3, 3), (4, 3), (None, 3), (5, 5), (6, 6)}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 16}
    assert f"{plain('word ' * 70000):016x}" in {r.fingerprint for r in got}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []


def test_drop_keeps_one_of_each_group(spark):
    rows = [(2, "a b c d", "s", 1), (1, "A b c d", "t", 2), (1, "a b c d", "t", 2), (7, None, None, None), (8, "other words here now", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, fp int")
    got = S.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 7, 8]


MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_words(text):
    words = {w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))}
    out = []
    for k in range(S.WIDE):
        ones = [0] * 64
        for w in words:
            x = (xxh64_intdigest(w) * (0x9E3779B97F4A7C15 + 2 * k) + k) & MASK
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
            x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
            x ^= x >> 31
            ones = [n + (x >> b & 1) for b, n in enumerate(ones)]
        out.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(words)))
    return out


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    x, y = five(a), five(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def plain_kept(rows):
    """Ids of ``(id, text)`` that stay."""
    order = lambda r: (r[0] is None, r[0] or 0)
    reps = {}
    for r in sorted(rows, key=order):
        reps.setdefault(plain(r[1]), r)
    root = {p: p for p in reps}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    seen = list(reps)
    for i, p in enumerate(seen):
        for q in seen[:i]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    prints = {p: plain_words(r[1]) for p, r in reps.items()}
    for k in range(S.WIDE):
        groups = {}
        for p in sorted(reps, key=signed):
            groups.setdefault(prints[p][k], []).append(p)
        firsts = [(w, own[0]) for w, own in groups.items()]
        pairs = [(own[0], q) for own in groups.values() for q in own[1:]]
        pairs += [(a, b) for i, (w, a) in enumerate(firsts) for v, b in firsts[:i] if (w ^ v).bit_count() <= 3]
        for a, b in pairs:
            if similarity(reps[a][1], reps[b][1]) >= S.SIMILAR:
                root[find(a)] = find(b)
    best = {}
    for p, r in reps.items():
        best[find(p)] = min(best.get(find(p), r), r, key=order)
    return {r[0] for r in best.values()}


def near_copies(n, words, changes, seed):
    """``n`` random texts, each with a copy in which so many words are others."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9)))
    common = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        text = [draw.choice(common) if draw.random() < 0.4 else word() for _ in range(words)]
        copy = list(text)
        for at in draw.sample(range(words), changes):
            copy[at] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    return rows


def test_drop_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in near_copies(40, 120, 2, 1)] + [(None, "only here"), (20_000, None), (20_001, "")]
    got = [r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_kept(rows)


def test_near_copies_are_dropped_and_others_stay(spark):
    rows = near_copies(150, 200, 3, 2)
    similar = {i for i, (_, a) in enumerate(rows[::2]) if similarity(a, rows[2 * i + 1][1]) >= S.SIMILAR}
    kept = {r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(150)} <= kept
    assert len(similar) > 140 and sum(2 * i + 1 not in kept for i in similar) >= 0.9 * len(similar)
    rows = near_copies(60, 100, 20, 3)
    assert S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
