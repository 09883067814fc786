"""Best-fit packing of token sequences by exact-complement hashing.

Texts become token ids on the executors; a document over the sequence length
is cut into full pieces, the first piece taking the remainder. Only the
histogram of piece lengths (as many rows as a sequence has tokens) reaches the
driver. There lengths are combined by count: for each length, longest first,
the gap it leaves is looked up among available single lengths, pair sums and
triple sums, and a combination that fills it exactly is used as often as the
counts allow; the rest is packed best-fit, longest first. The result is a short
list of patterns with multiplicities. A piece's gapless rank among those of its
length then decides its pattern, sequence and offset.

Ranks are two-level (hash buckets of bounded size within a length, then rows),
so a length that a third of all pieces share is spread over tasks.

Defined cases: null and empty texts are the end mark alone. Repeated rows and
ids are packed one by one. Texts are used whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm.common import in_arrow, saved

#: Rows of one length that are numbered in one task.
BUCKET_ROWS = 50_000
_LOADED: dict[str, object] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokenizer:
    """Byte-level BPE, by the ids of the JSON file, whose added tokens count as such in a text.

    The rank file holds the same vocabulary without them and is the faster one:
    it serves texts that hold none of the added tokens. Both give the same ids
    there; the JSON file also serves texts that the other library gives up on.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the library over a huge run of one kind of character
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


def tokenizer(json_name: str = "byte_bpe_50k.json", ranks_name: str | None = "byte_bpe_50k.tiktoken") -> Tokenizer:
    """The worker's tokenizer, loaded once."""
    if json_name not in _LOADED:
        import public_tokenizers

        ranks = vocabulary_path(ranks_name) if ranks_name else None
        _LOADED[json_name] = Tokenizer(vocabulary_path(json_name), ranks, public_tokenizers.PATTERN)
    return _LOADED[json_name]


PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer()
        for b in batches:
            out: list[tuple] = []
            for rid, doc, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                ids = np.array([*t.ids(text or ""), end_id], "<u4")
                at, n = 0, 0
                while at < len(ids):
                    size = (len(ids) - at - 1) % most + 1
                    out.append((rid, doc, n, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, n = at + size, n + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             names=["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def complements(count: np.ndarray, gap: int) -> Iterator[tuple[int, ...]]:
    """Available singles, then pairs, then triples of lengths that sum to ``gap``, longest part first.

    ``count`` may shrink between two answers; an answer holds when it is given.
    """
    if gap > 0 and count[gap]:
        yield (gap,)
    x = np.arange(gap - 1, 0, -1)
    for a in x[(count[x] > 0) & (count[gap - x] > 0) & (2 * x >= gap)]:
        yield (int(a), int(gap - a))
    for a in x[count[x] > 0]:
        rest = gap - int(a)
        if 3 * int(a) < gap:
            return
        y = np.arange(min(int(a), rest - 1), 0, -1)
        for b in y[(count[y] > 0) & (count[rest - y] > 0) & (2 * y >= rest)]:
            yield (int(a), int(b), rest - int(b))


def plan(histogram: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each; they use up the histogram."""
    count = np.zeros(most + 1, np.int64)
    for k, v in histogram.items():
        count[k] = v
    out: list[tuple[tuple[int, ...], int]] = []

    def times(parts: tuple[int, ...]) -> int:
        return min(int(count[p]) // parts.count(p) for p in parts)

    def use(parts: tuple[int, ...], n: int) -> None:
        for p in parts:
            count[p] -= n
        out.append((parts, n))

    if count[most]:
        use((most,), int(count[most]))
    for a in range(most - 1, 0, -1):
        if count[a]:
            for rest in complements(count, most - a):
                if n := times((a, *rest)):
                    use((a, *rest), n)
                if not count[a]:
                    break
    open_by_gap: dict[int, list[list]] = {}
    for a in range(most, 0, -1):
        n = int(count[a])
        while n:
            gap = min((g for g in open_by_gap if g >= a), default=None)
            if gap is None:
                each = min(n, most // a)
                parts, bins = (a,) * each, n // each
            else:
                parts, bins = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                each = min(n, gap // a)
                if bins > n // each:
                    open_by_gap.setdefault(gap, []).append([parts, bins - n // each])
                    bins = n // each
                parts = (*parts, *(a,) * each)
            n -= each * bins
            open_by_gap.setdefault(most - sum(parts), []).append([parts, bins])
    out += [(tuple(parts), bins) for group in open_by_gap.values() for parts, bins in group]
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], most: int) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset), sorted by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(most + 1, np.int64)
    first = 0
    for parts, n in patterns:
        offset = 0
        for p in parts:
            out.setdefault(p, []).append((int(used[p]), first, offset))
            used[p] += n
            offset += p
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                mine = length == k
                t = table[int(k)]
                i = np.searchsorted(t[:, 0], rank[mine], "right") - 1
                seq[mine], offset[mine] = t[i, 1] + rank[mine] - t[i, 0], t[i, 2]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    pieces = saved(in_arrow(rows, _pieces(most, end_id), PIECES), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``most`` rows
    table = slots(plan(histogram, most), most)
    buckets = {k: -(-n // BUCKET_ROWS) for k, n in histogram.items()}
    many = F.lit(1)
    if any(n > 1 for n in buckets.values()):
        pairs = [F.lit(x) for k, n in buckets.items() if n > 1 for x in (k, n)]
        many = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("length").cast("int")), F.lit(1))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid", "piece"), many))
    before = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid", "piece"))
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "bucket"])
    ranked = ranked.select("rid", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))
    return in_arrow(ranked, _place(table), PIECES + ", sequence_id long, offset long")


def report(docs: DataFrame) -> DataFrame:
    return pack(docs).drop("rid")
