"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the first 16 bytes of a digest of its role and text, and a conversation's key its turns' ids in a row.
Conversations are dealt out by ranges of (key, conversation), so that neighbours share most turns and a first turn, or a
whole conversation, that a third of all have is spread over as many tasks as it takes. A task cuts its range into blocks
of bounded size and builds a radix tree of each: inner nodes grow from 4 to 16, 48 and 256 children, bytes that no branch
parts are kept in one piece, and only depths of whole turns put out nodes of the trie.

A node whose conversations all lie in one block is complete there. One that goes on in the block before or after (of which
a block knows how many turns it shares with its own edge) puts out what the block knows, and such parts are added up:
members, children and leaves that no earlier (later) block counts, code points of members' turns, and of distinct turns,
whose difference is what sharing saves. Parts are as many as blocks times the turns that neighbours share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship

ship(__name__)

WIDTH = 16  # bytes of a turn's id
_BLOCK_ROWS, _BLOCK_BYTES = 20_000, 8 << 20


class _Few:
    """Up to 4 or 16 children beside a list of their bytes."""

    def __init__(self, room: int):
        self.room, self.at, self.kids = room, bytearray(), []

    def get(self, byte: int):  # noqa: ANN201
        i = self.at.find(byte)
        return None if i < 0 else self.kids[i]

    def put(self, byte: int, kid: Node):  # noqa: ANN201
        if len(self.kids) == self.room:
            more = _Few(16) if self.room == 4 else _Indexed()
            for b, k in zip(self.at, self.kids, strict=True):
                more.put(b, k)
            return more.put(byte, kid)
        self.at.append(byte)
        self.kids.append(kid)
        return self


class _Indexed:
    """Up to 48 children, found by a table of 256 places."""

    def __init__(self):
        self.place, self.kids = bytearray(256), []

    def get(self, byte: int):  # noqa: ANN201
        i = self.place[byte]
        return self.kids[i - 1] if i else None

    def put(self, byte: int, kid: Node):  # noqa: ANN201
        if len(self.kids) == 48:
            more = _Full()
            for b in range(256):
                if self.place[b]:
                    more.put(b, self.kids[self.place[b] - 1])
            return more.put(byte, kid)
        self.kids.append(kid)
        self.place[byte] = len(self.kids)
        return self


class _Full:
    """A child for any byte."""

    def __init__(self):
        self.slots = [None] * 256

    @property
    def kids(self) -> list[Node]:
        return [k for k in self.slots if k is not None]

    def get(self, byte: int):  # noqa: ANN201
        return self.slots[byte]

    def put(self, byte: int, kid: Node):  # noqa: ANN201
        self.slots[byte] = kid
        return self


class Node:
    """Bytes that all keys below share, the keys' rows that end after them, and children by the next byte."""

    __slots__ = ("shared", "rows", "below")

    def __init__(self, shared: bytes, rows: list[int] | None = None):
        self.shared, self.rows, self.below = shared, rows or [], _Few(4)


def _same(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first `low` are equal, the first `high` aren't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def insert(root: Node, key: bytes, row: int) -> None:
    node, at = root, 0
    while True:
        n = len(node.shared)
        if not key.startswith(node.shared, at):
            n = _same(node.shared, key[at : at + n])
            rest, node.shared = node.shared, node.shared[:n]
            lower = Node(rest[n + 1 :], node.rows)
            lower.below, node.rows, node.below = node.below, [], _Few(4).put(rest[n], lower)
        at += n
        if at == len(key):
            node.rows.append(row)
            return
        kid = node.below.get(key[at])
        if kid is None:
            node.below = node.below.put(key[at], Node(key[at + 1 :], [row]))
            return
        node, at = kid, at + 1


class _Sum:
    """What is known of the keys below a tree's node: how many, the first and last row, the least conversation, code
    points of their turns from here on and of distinct ones, leaves, and the trie's nodes right below."""

    __slots__ = ("n", "low", "high", "least", "said", "once", "leaves", "kids", "tops")

    def __init__(self):
        self.n, self.low, self.high, self.least, self.said, self.once, self.leaves, self.kids, self.tops = 0, 1 << 62, -1, None, 0, 0, 0, 0, []

    def add(self, n: int, low: int, high: int, least: int) -> None:
        self.n += n
        self.low, self.high = min(self.low, low), max(self.high, high)
        self.least = least if self.least is None else min(self.least, least)


def _prefixes(key: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, ... ``depth`` turns: names of nodes that several blocks share."""
    digest, out = hashlib.sha256(), []
    for d in range(depth + 1):
        digest.update(key[(d - 1) * WIDTH : d * WIDTH] if d else b"")
        out.append(digest.digest()[:WIDTH])
    return out


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, parent binary, first long, ends string"
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in _NODE.split(", ")]


def grow(convs: list[int], keys: list[bytes], chars: list[list[int]], before: int = -1, after: int = -1) -> list[list]:
    """Rows of :data:`_NODE` of a block of sorted keys, of which the first shares ``before`` turns with the block before
    (-1: there is none) and the last ``after`` turns with the next."""
    root, last = Node(b""), len(keys) - 1
    for i, key in enumerate(keys):
        insert(root, key, i)
    left, right = _prefixes(keys[0], before), _prefixes(keys[last], after)
    order: list[tuple[Node, int, int]] = [(root, -1, -1)]
    for up, (node, _, start) in enumerate(order):  # grows while it is read: every node after the one above it
        end = start + 1 + len(node.shared) if up else len(node.shared)
        order.extend((kid, up, end) for kid in node.below.kids)
    sums = [_Sum() for _ in order]
    out: list[list] = []
    for (node, up, start), s in zip(reversed(order), reversed(sums), strict=True):
        end = start + 1 + len(node.shared) if up >= 0 else len(node.shared)
        if node.rows:
            s.add(len(node.rows), node.rows[0], node.rows[-1], min(convs[i] for i in node.rows))
        for depth in range(end // WIDTH, start // WIDTH if up >= 0 else -1, -1):
            earlier, later = s.low == 0 and depth <= before, s.high == last and depth <= after
            length = chars[s.low][depth - 1] if depth else 0
            s.said += s.n * length
            s.once += 0 if earlier else length
            s.leaves += not s.tops and not later
            name = left[depth] if earlier else right[depth] if later else None
            for row in s.tops:
                out[row][2 if name is None else 9] = s.least if name is None else name
            ends = ",".join(str(convs[i]) for i in node.rows) if depth * WIDTH == end else ""
            digest, first, text = (hashlib.sha256(ends.encode()).hexdigest(), None, None) if name is None else (None, convs[node.rows[0]] if ends else None, ends or None)
            s.tops, kids = [len(out)], s.kids
            s.kids = int(not earlier)
            out.append([s.least, depth, None, s.n, kids, s.leaves, s.said - s.once, digest, name, None, first, text])
        if up >= 0:
            top = sums[up]
            top.add(s.n, s.low, s.high, s.least)
            top.said, top.once, top.leaves, top.kids = top.said + s.said, top.once + s.once, top.leaves + s.leaves, top.kids + s.kids
            top.tops += s.tops
    return out


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order (nulls first, equal ones by what they say), as an array of
    ids and code points. Null roles and texts are empty; rows without a conversation are left out."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 2 * WIDTH)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), digest.alias("id"), F.length(said).alias("chars")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    return rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(ordered.alias("turns"))


def with_openings(convs: DataFrame, turns_taken: Column, most: int, group: int = 100) -> DataFrame:
    """Each conversation's first ``turns_taken`` turns (``most`` at most) exchanged for those of its group's first one: the
    one whose id is the next lower multiple of ``group``. Where there is none, they are just gone."""
    donor, none = F.col("conv_id") - F.col("conv_id") % group, F.array().cast(convs.schema["turns"].dataType)
    openings = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most).alias("opening"))
    opened = convs.withColumn("donor", donor).withColumn("h", turns_taken.cast("int")).join(openings, "donor", "left")
    taken = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h"))
    return opened.select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's sorted conversations as rows of a block each, with the turns that its edges share inside the range."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    convs, keys, chars, size, number, before = [], [], [], 0, 0, None

    def row(after: int | None) -> pa.RecordBatch:
        values = [part, number, before, after, keys[0], keys[-1], convs, keys, chars]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "before", "after", "first_key", "last_key", "convs", "keys", "chars"])

    for batch in batches:
        for conv, key, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(keys) >= _BLOCK_ROWS or size >= _BLOCK_BYTES:
                shared = _same(keys[-1], key) // WIDTH
                yield row(shared)
                convs, keys, chars, size, number, before = [], [], [], 0, number + 1, shared
            convs.append(conv)
            keys.append(key)
            chars.append(lengths)
            size += len(key)
    if keys:
        yield row(None)


def _turns_shared(a, b):  # noqa: ANN001, ANN202
    return None if a is None or b is None else _same(bytes(a), bytes(b)) // WIDTH


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            rows = grow(*(c[i].as_py() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _FIELDS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, ends_sha256)`` of texts in order, one after another, joined by commas."""
    now, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node == now:
                digest.update(b"," + text.encode())
                continue
            if now is not None:
                done.append((now, digest.hexdigest()))
            now, digest = node, hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def nodes(convs: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, from ``(conv_id, turns)`` of :func:`sequences`.

    ``conv_id`` is the smallest of the ``n_convs`` conversations that begin so, ``depth`` their common turns,
    ``parent_conv_id`` the name of the node above (null for the root), ``n_children`` and ``n_leaves`` the nodes right
    below and the childless ones anywhere below or here, ``saved_tokens`` the code points that needn't be said twice, and
    ``ends_sha256`` the digest of the conversations that end here. Conversations without turns end at the root; equal ones
    share all nodes; repeated ids are members each; an empty table gives an empty table. A conversation is one row of 20
    bytes a turn; the digest of one node's ends is sequential, so it is one task, which reads them as a stream.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keyed = materialize(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "keys")
    ranges = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = "part long, block long, before long, after long, first_key binary, last_key binary, convs array<long>, keys array<binary>, chars array<array<int>>"
    packed = materialize(dealt.mapInArrow(_blocks, blocks), "blocks")
    edges = packed.groupBy("part").agg(F.min_by("first_key", "block").alias("a"), F.max_by("last_key", "block").alias("b"))
    along = Window.orderBy("part")  # one row for each range
    edges = edges.select("part", "a", "b", F.lag("b").over(along).alias("up"), F.lead("a").over(along).alias("down"))
    shared = F.udf(_turns_shared, T.LongType())  # of a handful of rows
    edges = edges.select("part", shared("up", "a").alias("up"), shared("b", "down").alias("down"))
    whole = packed.join(F.broadcast(edges), "part")  # two numbers for each range
    sides = [F.coalesce(a, b, F.lit(-1)).cast("long").alias(a) for a, b in (("before", "up"), ("after", "down"))]
    found = materialize(whole.select("convs", "keys", "chars", *sides).mapInArrow(_grown, _NODE), "nodes")

    parts = found.where(F.col("node").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    joined = parts.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), *sums)
    texts = parts.where(F.col("ends").isNotNull()).repartition("node").sortWithinPartitions("node", "first").select("node", "ends")
    joined = joined.join(texts.mapInArrow(_digests, "node binary, ends_sha256 string"), "node", "left")
    joined = materialize(joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "shared")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = found.where(F.col("node").isNull())
    named = joined.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    known = inside.where(F.col("parent").isNull()).select(*columns)
    under = inside.drop("parent_conv_id").unionByName(joined, allowMissingColumns=True).where(F.col("parent").isNotNull()).join(named, "parent")
    tops = joined.where(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return known.unionByName(under.withColumnRenamed("above", "parent_conv_id").select(*columns)).unionByName(tops.select(*columns))


SQL = r"""
WITH RECURSIVE crcs AS MATERIALIZED (
  SELECT conv_id, raw, CAST(4294967295 AS UBIGINT) AS c, 0 AS i FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS raw FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, raw, list_reduce(list_prepend(xor(c, CAST(ascii(raw[CAST(i // 8 + 1 AS INTEGER)]) AS UBIGINT)), range(0, 8)::UBIGINT[]), lambda a, k: xor(a >> 1, (a & 1) * 3988292384)), i + 8
  FROM crcs WHERE i < 8 * length(raw)),
h AS (SELECT conv_id, CAST(xor(c, 4294967295) % 6 AS INTEGER) AS h FROM crcs WHERE i = 8 * length(raw)),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS MATERIALIZED (
  SELECT o.conv_id, list_concat(coalesce(d.s, [])[1:h], o.s[h + 1:]) AS s
  FROM own o JOIN h USING (conv_id) LEFT JOIN own d ON d.conv_id = o.conv_id - o.conv_id % 100),
keys AS MATERIALIZED (SELECT conv_id, len(s) AS n, s, list_transform(s, lambda x: md5(CAST(length(x.r) AS VARCHAR) || ':' || x.r || x.t)) AS k FROM built),
paths AS MATERIALIZED (
  SELECT conv_id, n, d, array_to_string(k[1:d], '') AS node, CASE WHEN d > 0 THEN array_to_string(k[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM keys)),
nodes AS MATERIALIZED (
  SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
  FROM paths GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
lines AS (SELECT node, unnest(range(0, depth + 1)) AS d, saved, NOT EXISTS (SELECT 1 FROM kids k WHERE k.node = nodes.node) AS leaf FROM nodes),
under AS (SELECT substring(node, 1, 32 * d) AS node, sum(saved) AS saved, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves FROM lines GROUP BY ALL)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.node = x.up LEFT JOIN kids k ON k.node = x.node JOIN under u ON u.node = x.node
"""
