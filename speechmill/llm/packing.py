"""Texts packed into containers of fixed capacity: bounded-space online best fit, then leftovers merged."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, small_enough
from .arrow import map_batches, spread

#: Vocabulary whose tokens are counted; any file that sentencepiece or tokenizers reads.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
CAPACITY = 2_048
#: Windows that a task keeps open.
OPEN_WINDOWS = 64
#: About so many texts are packed by one task.
PART_TEXTS = 50_000
#: Texts tokenized in one call.
AT_ONCE = 128
#: Leftover windows that one task merges.
MERGE_WINDOWS = 8_192

_COUNTERS: dict[str, object] = {}


def token_counter(path: str):
    """Function from texts to their numbers of tokens, one for each Python worker."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            words = Tokenizer.from_file(path)
            words.encode_special_tokens = True
            encode = lambda texts: [len(x.ids) for x in words.encode_batch(texts, add_special_tokens=False)]
        # A few texts at a time: only the numbers stay, not the tokens of a whole batch.
        _COUNTERS[path] = lambda texts: [n for i in range(0, len(texts), AT_ONCE) for n in encode(texts[i : i + AT_ONCE])]
    return _COUNTERS[path]


class Windows:
    """At most ``most`` open windows; an item goes where it leaves the least room."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.number = capacity, most, first
        self.free: list[tuple[int, int]] = []

    def place(self, size: int) -> tuple[int, int]:
        """(window, place in it) of an item no larger than the capacity; closes the fullest when none fits and all are open."""
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most and size < self.capacity:
                self.free.pop(0)
            room, window = self.capacity, self.number
            self.number += 1
        if room > size:
            insort(self.free, (room - size, window))
        return window, self.capacity - room


def pack(docs: DataFrame, doc_id: str, doc_text: str, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(container_id, seat, doc_id, piece, first_token, n_tokens): every text in one container, ``seat`` tokens from its start.

    A text is cut only if it alone exceeds the capacity: into full containers and a rest. Null texts have no row, empty ones a piece
    of no tokens, repeated rows a place each. Texts are counted where they lie; then the numbers alone, in an order that follows from the texts,
    are packed in parts of ``PART_TEXTS`` with a fixed number of open windows each, so the layout depends on the texts and not on the cluster.
    What is still open at the end of a part is packed as whole windows, the fullest first, by a task for every so many of them.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        count = token_counter(tokenizer)
        for batch in batches:
            yield {"doc_id": batch.column(0).to_pylist(), "key": batch.column(1).to_pylist(), "n": count(batch.column(2).to_pylist())}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        windows = Windows(capacity, open_windows, TaskContext.get().partitionId() << 36)
        names = ["doc_id", "piece", "first_token", "n_tokens", "window", "seat", "filled"]
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for doc, n in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()):
                piece = at = 0
                while True:
                    size = min(capacity, n - at)
                    window, seat = windows.place(size)
                    for k, x in zip(names, (doc, piece, at, size, window, seat, None)):
                        out[k].append(x)
                    piece, at = piece + 1, at + size
                    if at >= n:
                        break
            yield out
        left = windows.free
        none = [None] * len(left)
        yield {"doc_id": none, "piece": none, "first_token": none, "n_tokens": none, "window": [w for _, w in left], "seat": none, "filled": [capacity - room for room, _ in left]}

    schema = "doc_id long, piece int, first_token int, n_tokens int, window long, seat int, filled int"
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("_text")).where("_text IS NOT NULL")
    texts = texts.select("doc_id", F.xxhash64("doc_id", "_text").alias("key"), "_text")
    counted = materialize(map_batches(spread(texts, "doc_id"), sizes, "doc_id long, key long, n int"))
    parts = max(1, -(-counted.count() // PART_TEXTS))
    placed = materialize(map_batches(counted.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "n"), place, schema))
    left = placed.where("filled IS NOT NULL").select("window", "filled")
    n = left.count()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        # A window is named after the first of those it takes in; no bound on open ones, as the task's share is bounded.
        windows = Windows(capacity, MERGE_WINDOWS * 4, 0)
        name: dict[int, int] = {}
        for batch in batches:
            out: dict[str, list] = {"window": [], "into": [], "shift": []}
            for window, filled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to, seat = windows.place(filled)
                out["window"].append(window)
                out["into"].append(name.setdefault(to, window))
                out["shift"].append(seat)
            yield out

    shuffled = left.repartition(max(1, -(-n // MERGE_WINDOWS)), "window").sortWithinPartitions(F.desc("filled"), "window")
    moved = map_batches(shuffled, merge, "window long, into long, shift int")
    if small_enough(n, 32):
        moved = F.broadcast(moved)
    items = placed.where("filled IS NULL").join(moved, "window", "left")
    return items.select(F.coalesce("into", "window").alias("container_id"), (F.col("seat") + F.coalesce("shift", F.lit(0))).alias("seat"), "doc_id", "piece", "first_token", "n_tokens")


def placed_texts(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, copies, faults): how often each text was placed, and how many of its pieces overlap another, lie outside their container, leave a
    part of the text out, or were cut without need."""
    by = Window.partitionBy("container_id").orderBy("seat", "n_tokens")
    ends = packed.withColumn("_end", F.col("seat") + F.col("n_tokens")).withColumn("_before", F.max("_end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    fault = (F.col("seat") < F.coalesce("_before", F.lit(0))) | (F.col("_end") > capacity) | (F.col("first_token") != F.col("piece") * capacity)
    short = F.sum(F.when((F.col("piece") > 0) & (F.col("n_tokens") < 1), 1).otherwise(0))
    return ends.groupBy("doc_id").agg(F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("copies"), (F.sum(fault.cast("int")) + short).alias("faults"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, items, tokens, unused) of each container."""
    return packed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens")).withColumn("unused", capacity - F.col("tokens"))
