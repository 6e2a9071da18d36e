import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import queries, trie


def rebuilt(rows, group=100):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return [(c, own.get(c - c % group, [])[: h[c]] + s[h[c] :]) for c, s in own.items()]


def plain(convs):
    nodes = {}
    for c, s in convs:
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append((c, len(s) == d))
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)

    def below(n):
        todo, leaves, saved = [n], 0, 0
        while todo:
            x = todo.pop()
            saved += (len(nodes[x]) - 1) * len(x[-1][1]) if x else 0
            leaves += x not in kids
            todo += kids.get(x, [])
        return leaves, saved

    least = {n: min(c for c, _ in m) for n, m in nodes.items()}
    ends = lambda m: hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()
    return sorted(((least[n], len(n), least[n[:-1]] if n else None, len(m), len(kids.get(n, [])), *below(n), ends(m)) for n, m in nodes.items()), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "conv_id long, turn long, role string, text string, node string, key binary")
    taken = F.crc32(F.col("conv_id").cast("string")) % 6
    return sorted((tuple(r) for r in trie.nodes(trie.with_openings(trie.sequences(df), taken, 5)).collect()), key=str)


@pytest.mark.parametrize("block", [3, 20_000])
def test_like_a_plain_trie_over_several_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "_BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = []
    for c in [*range(60), *range(100, 140), *range(230, 260)]:
        for t in range(rng.randrange(9)):
            rows.append((c, None if rng.random() < 0.03 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "äö𝄞", "long " * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(7)]  # a hot conversation
    rows += [(400 + c, t, "user", f"chain {t}") for c in range(12) for t in range(c)]
    rows += rows[5:9]
    assert found(spark, rows) == plain(rebuilt(rows))


def test_odd_rows(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(1, 0, "user", "x")], [(7, None, None, None)], [(5, 0, "user", "y" * 300_000), (5, 1, "user", "z"), (105, 0, "user", "z")]):
        assert found(spark, rows) == plain(rebuilt(rows))


def test_a_very_long_conversation_beside_shorter_ones(spark, monkeypatch):
    monkeypatch.setattr(trie, "_BLOCK_ROWS", 2)
    rows = [(c, t, "user", str(t)) for c, n in ((1, 150), (2, 149), (3, 10), (4, 150), (5, 1)) for t in range(n)]
    want = {(r[0], r[1]): r for r in plain(rebuilt(rows)) if r[1] < 12 or r[1] > 140}
    got = found(spark, rows)
    assert {(r[0], r[1]): r for r in got if (r[0], r[1]) in want} == want and len(got) == len({(r[0], r[1]) for r in got})


def test_whole_smallest_table(spark, sf):
    got = sorted((tuple(r) for r in queries.op12_radix_conversations(spark, sf).collect()), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain(rebuilt(rows))


def test_layouts_grow():
    root = trie.Node(b"")
    keys = sorted({bytes(random.Random(i).randbytes(2)) for i in range(3000)})
    kinds = set()
    for i, k in enumerate(keys):
        trie.insert(root, k, i)
        kinds.add((type(root.below).__name__, getattr(root.below, "room", 0)))
    assert kinds == {("_Few", 4), ("_Few", 16), ("_Indexed", 0), ("_Full", 0)}
    for i, k in enumerate(keys):
        kid = root.below.get(k[0])
        assert i in (kid.rows if kid.shared == k[1:] else kid.below.get(k[1]).rows)
