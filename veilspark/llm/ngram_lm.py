"""Language-model scoring by a weighted backoff automaton.

Every n-gram of the training texts, seen once or more, is an arc; every one that words follow is a state. Unigrams are
add-one smoothed over all training tokens; a longer n-gram's probability mixes its count with the shorter one's
probability as if that had been seen ``PRIOR`` times (a Dirichlet prior), so the failure arc of a state seen c times
weighs PRIOR / (c + PRIOR) and every state's probabilities sum to one. A text is scored in one left-to-right traversal
that carries the state: it takes the state's arc, or falls to the next shorter state for the failure arc's weight.

The automaton grows with the corpus and is never in one place. Texts are dealt into blocks of about a million tokens.
A block asks for the training totals of its distinct n-grams, which are added up in buckets of the key space: keys are
hashes, so buckets are even however common an n-gram is, and a block names a key once. It asks by length, and for a
longer n-gram only if both its parts are in other blocks too: else it isn't there either, and the block's own count is
the total. In the end a block knows every arc and state that its own texts can meet, for the
totals give their probabilities and the failure weights, and traverses them. Blocks and what they are told are one
table bucketed by block, so that a block is shuffled never and an answer once.

N-grams are known by so many bits of a hash that one shares its key with another in 2^28 cases at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, ship

ship(__name__)

ORDER = 3
PRIOR = 12.0
END = b"\n"  # no word holds white space
_BLOCK_TOKENS, _BUCKET_KEYS, _MIN_BITS = 1_000_000, 1_000_000, 9
_ASKS = "block long, bucket long, keys binary, counts binary"


def tokens(raw: bytes | None) -> list[bytes]:
    return [*(raw or b"").lower().split(), END]


def _pack(x: np.ndarray) -> bytes:
    """Compressed by planes: all numbers' first bytes, then all second ones."""
    raw = x.view("u1").reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True), "u1")
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pairs of hashes ``(a, b)``."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _table(names: str, rows: list[tuple]) -> pa.Table:
    """Rows of a block's number, a bucket's number and binary columns."""
    fields = pa.schema([(name, pa.int64() if i < 2 else pa.binary()) for i, name in enumerate(names.split())])
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def blocks(docs: DataFrame) -> DataFrame:
    """Texts (id, text, train) as blocks: whether they train, their lengths, their tokens as places in a list, and that
    list of hashes of words."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        block = TaskContext.get().partitionId() << 32
        ids: list = []
        train: list[bool] = []
        lengths: list[int] = []
        held: list[int] = []
        seen: dict[bytes, int] = {}

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal block
            hashes = np.fromiter(map(xxh64_intdigest, seen), "<u8", len(seen))
            a, *rest = (pa.array([_pack(x)], pa.binary()) for x in (np.array(train, "?"), np.array(lengths, "<i8"), np.array(held, "<u4"), hashes))
            columns = [pa.array([block]), pa.array([0], pa.int32()), pa.array([0]), a, pa.array([len(held)]), pa.array([ids], pa.list_(kind)), *rest]
            for x in (ids, train, lengths, held, seen):
                x.clear()
            block += 1
            return pa.RecordBatch.from_arrays(columns, ["block", "length", "bucket", "a", "n", "ids", "b", "c", "d"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, raw, learn in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                words = tokens(raw.as_py())
                ids.append(key)
                train.append(learn)
                lengths.append(len(words))
                held.extend([seen.setdefault(w, len(seen)) for w in words])
                if len(held) >= _BLOCK_TOKENS:
                    yield flush(kind)
        if ids:
            yield flush(kind)

    return docs.select("id", "text", "train").mapInArrow(run, f"block long, length int, bucket long, a binary, n long, ids array<{id_type}>, b binary, c binary, d binary")


class Level:
    """A block's distinct n-grams of one length, by key: ``at`` has the place of the one that ends at each token, or -1
    where the text has fewer words so far; ``own`` counts it in the block's training texts, ``total`` in all."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, learned: np.ndarray, asked: np.ndarray):
        self.keys, self.at, self.asked = keys, at, asked
        self.own = np.bincount(at[learned & (at >= 0)], minlength=len(keys))

    def hear(self, totals: list[np.ndarray]) -> None:
        told = np.concatenate([*totals, np.zeros(0, "<i8")])
        self.total, self.elsewhere = self.own.copy(), np.zeros(len(self.keys), dtype=bool)
        self.total[self.asked], self.elsewhere[self.asked] = told >> 1, told & 1

    def counts(self) -> np.ndarray:
        """Totals by token, zero where there is no such n-gram."""
        return np.append(self.total, 0)[self.at]


class Block:
    """A block's texts and what it has been told of n-grams up to ``told`` words."""

    def __init__(self, rows: pa.Table, told: int, order: int, width: int):
        parts: dict[int, list] = {}
        for x in rows.to_pylist():
            parts.setdefault(x["length"], []).append(x)
        text = parts[0][0]
        self.number, self.ids, self.train, self.lengths = text["block"], text["ids"], _unpack(text["a"], "?"), _unpack(text["b"], "<i8")
        held, hashes = _unpack(text["c"], "<u4"), _unpack(text["d"], "<u8")
        shift, learned = np.uint64(64 - width), np.repeat(self.train, self.lengths)
        so_far = np.arange(len(held)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        keys, place = np.unique(hashes >> shift, return_inverse=True)
        self.levels = [Level(keys, place[held], learned, np.ones(len(keys), dtype=bool))]
        word = gram = hashes[held]
        for n in range(1, order + 1):
            low = self.levels[-1]
            if n > told:
                break
            low.hear([_unpack(x["a"], "<i8") for x in sorted(parts.get(n, []), key=lambda x: x["bucket"])])
            if n < order:
                gram = np.concatenate([gram[:1], _mixed(gram[:-1], word[1:])])
                ends = np.flatnonzero(so_far >= n)
                keys, first, place = np.unique(gram[ends] >> shift, return_index=True, return_inverse=True)
                at, last = np.full(len(word), -1), ends[first]
                at[ends] = place
                self.levels.append(Level(keys, at, learned, low.elsewhere[low.at[last - 1]] & low.elsewhere[low.at[last]]))

    def asks(self, bits: int, width: int) -> pa.Table:
        """The keys to ask for next with their training occurrences in the block, by bucket."""
        level = self.levels[-1]
        keys, own = level.keys[level.asked], level.own[level.asked].astype("<i8")
        cuts = np.searchsorted(keys >> np.uint64(width - bits), np.arange(2**bits + 1, dtype=np.uint64)).tolist()
        spans = [(bucket, i, j) for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
        return _table("block bucket keys counts", [(self.number, bucket, _pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(own[i:j])) for bucket, i, j in spans])

    def scored(self, size: tuple[int, int]) -> Iterator[tuple[int, int, float, float]]:
        """For each text its tokens, those known, and its log probabilities by unigrams alone and by the automaton."""
        seen = self.levels[0].counts()
        known = seen > 0
        p = (seen + 1) / (sum(size) + 1)
        logs, falls = [np.log10(p)], []
        for level in self.levels[1:]:
            falls.append(np.log10(PRIOR / (seen + PRIOR)))
            history, seen = np.concatenate([[0], seen[:-1]]), level.counts()
            p = (seen + PRIOR * p) / (np.where(level.at >= 0, history, 0) + PRIOR)
            logs.append(np.where(seen > 0, np.log10(p), 1.0))  # no arc; logs of probabilities are negative
        start = 0
        for n in self.lengths.tolist():
            part = slice(start, start + n)
            score = traverse([x[part].tolist() for x in logs], [x[part].tolist() for x in falls], known[part].tolist())
            yield n, int(known[part].sum()), float(logs[0][part].sum()), score
            start += n


def traverse(logs: list[list[float]], falls: list[list[float]], known: list[bool]) -> float:
    """The log probability of a text. The state is the length of the history carried, of which the failure arcs drop
    the first word; ``logs[n]`` has each token's arc from a history of n words, or 1 for none."""
    score, state, most = 0.0, 0, len(falls)
    for i, some in enumerate(known):
        while state:
            arc = logs[state][i]
            if arc <= 0:
                break
            score += falls[state - 1][i - 1]
            state -= 1
        score += logs[state][i]
        state = min(state + 1, most) if some else 0
    return score


def _added(key: tuple, asks: pa.Table) -> pa.Table:
    """A bucket's totals, returned to each block for its own keys in their order: twice the total, plus one if another
    block has the key.

    A row of block -1 counts the bucket's training tokens and its distinct n-grams.
    """
    rows = asks.select(["block", "keys", "counts"]).to_pylist()
    parts = [np.cumsum(_unpack(x["keys"], "<u8"), dtype="<u8") for x in rows]  # sorted, so sent as steps
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(place, np.concatenate([_unpack(x["counts"], "<i8") for x in rows]), len(keys)).astype("<i8")
    told = totals << 1 | (np.bincount(place) > 1)
    mine = np.split(place, np.cumsum([len(p) for p in parts])[:-1])
    out = [(x["block"], key[0].as_py(), _pack(told[at])) for x, at in zip(rows, mine, strict=True)]
    return _table("block bucket a", [*out, (-1, key[0].as_py(), _pack(np.array([totals.sum(), (totals > 0).sum()], "<i8")))])


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: id, ``held_out``, token counts, unigram and automaton log10 probabilities.

    A null text is empty and scores its end token; a very long text is a block of its own, scored whole; columns of other
    names are left behind; repeated rows are scored each; a model without training tokens
    gives every word the unknown word's probability. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    id_type = docs.schema["id"].dataType.simpleString()
    buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, "blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")

    def keep(rows: DataFrame) -> None:
        rows.write.bucketBy(buckets, "block").option("path", path).option("compression", "none").mode("append").saveAsTable(name)

    def asker(told: int):  # noqa: ANN202
        return lambda rows: Block(rows, told, order, width).asks(bits, width)

    keep(blocks(docs))
    held = spark.table(name).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, width = max(_MIN_BITS, (held // _BUCKET_KEYS).bit_length()), min(64, max(48, 28 + held.bit_length()))
    size = (0, 0)
    for n in range(1, order + 1):

        asks = spark.table(name).where("block >= 0").groupBy("block").applyInArrow(asker(n - 1), _ASKS)
        told = asks.groupBy("bucket").applyInArrow(_added, "block long, bucket long, a binary")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("ids", f"array<{id_type}>"), *((c, "binary") for c in "bcd"))]
        keep(told.select("block", F.lit(n).alias("length"), "bucket", "a", *nothing).repartition(buckets, "block"))
        if n == 1:
            sums = spark.table(name).where("block = -1").select("a").toLocalIterator()  # a row of two numbers for each bucket
            size = tuple(int(x) for x in sum((_unpack(bytes(r.a), "<i8") for r in sums), np.zeros(2, "<i8")))

    def score(rows: pa.Table) -> pa.Table:
        block = Block(rows, order, order, width)
        columns = [*zip(*block.scored(size), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        ids = pa.array(block.ids, rows.schema.field("ids").type.value_type)
        out = [ids, pa.array(~block.train), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))]
        return pa.table(out, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    told = spark.table(name).where("block >= 0").groupBy("block")
    scored = told.applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(size[0]).cast("long").alias("train_tokens"), "base_score", "score")
