"""SentencePiece encoding through a table of distinct chunks, and decoding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyarrow import fs, parquet
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from keyrill.llm.shared import columns, cut, new_path

MARK = "▁"
#: Chunks: a run of markers with what follows up to the next marker or line end, or a line end.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
#: Chunks, of so many characters at most, that every task has at hand; they are the most frequent ones of a
#: part of the texts. That saves shuffling them and changes no result.
HEAD, HEAD_CHARS, HEAD_SHARE = 131_072, 64, 64
#: Distinct chunks, and characters in them, that a task lists before it passes them on.
LISTED, LISTED_CHARS = 1_000_000, 1 << 25
ROWS = 256


def chunks_of(text: str) -> list[str]:
    """A text's chunks in order; the marker that the library puts first is the first chunk's."""
    return CHUNK.findall(" " + text) if text else []


class PieceCodec:
    """Encodes and decodes as the library does, with an end id.

    Merges join neighbouring pieces, so if no piece has a marker after another
    character or a line end beside one, none crosses a chunk's border, and a
    text's ids are its chunks' ids in order. The marker that the library puts
    before a text is put there first, and chunks are encoded without one. A
    model whose pieces can cross, or that rewrites texts first, is used on
    whole texts.
    """

    def __init__(self, model: bytes):
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        self.by_chunk = (
            not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
            and spec.trainer_spec.model_type in (1, 2) and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == 4 or re.search(f"[^{MARK}]{MARK}", p.piece) or "\n" in p.piece for p in spec.pieces)
        )
        norm.add_dummy_prefix = False
        self.single = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.end = np.array([self.whole.eos_id()], np.int32).tobytes()

    def segment(self, chunk: str) -> bytes:
        """A chunk's ids as int32 bytes."""
        return np.array(self.single.encode(chunk), np.int32).tobytes()

    def encode(self, text: str, table: dict[str, bytes] | None = None) -> np.ndarray:
        """A text's ids, its chunks' ids from the table; a chunk that is not there is segmented and added."""
        if not self.by_chunk:
            return np.array(self.whole.encode(text, add_eos=True), np.int32)
        table = {} if table is None else table
        chunks = chunks_of(text)
        try:
            return np.frombuffer(b"".join([*map(table.__getitem__, chunks), self.end]), np.int32)
        except KeyError:
            for c in chunks:
                if c not in table:
                    table[c] = self.segment(c)
            return np.frombuffer(b"".join([*map(table.__getitem__, chunks), self.end]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


#: The codec of this Python worker, kept between tasks.
_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    if model not in _CODECS:
        _CODECS.clear()
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, n of a task's texts; some come again."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            seen: Counter = Counter()
            for t in batch.column("text").slice(at, ROWS).to_pylist():
                seen.update(chunks_of(t or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])


def _segmented(model: bytes, *kept: str) -> Callable:
    """Adds ids to rows in order of the chunk, each distinct one segmented once; of the others the kept columns stay."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, last, ids = codec(model), None, b""
        for batch in batches:
            found = []
            for chunk in batch.column("chunk").to_pylist():
                if chunk != last:
                    last, ids = chunk, c.segment(chunk)
                found.append(ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), batch.column("chunk"), pa.array(found, pa.binary())], [*kept, "chunk", "ids"])

    return each


def frequent_chunks(docs: DataFrame, model: bytes, head: int = HEAD) -> dict[str, bytes]:
    """chunk -> ids of at most `head` chunks, the most frequent ones of a HEAD_SHAREth of the different texts."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(HEAD_SHARE)) == 0).select("text")
    counts = some.mapInArrow(counted, "chunk string, n long").where(F.length("chunk") <= HEAD_CHARS).groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = cut(counts.where("n > 1"), "chunk-counts")
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("size")).agg(F.count("*").alias("chunks"), F.min("n").alias("least")).collect()
    floor, room = 1 << 62, head
    for r in sorted(steps, key=lambda r: -r["size"]):
        room -= r["chunks"]
        if room < 0:
            break
        floor = r["least"]
    rows = counts.where(F.col("n") >= floor).select("chunk").mapInArrow(_segmented(model), "chunk string, ids binary").collect()
    return {r["chunk"]: bytes(r["ids"]) for r in rows}


def _listed(shipped: Broadcast) -> Callable:
    """task, chunk: the distinct chunks of a task's texts that not every task has; some come again after a full list was passed on."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, chars = TaskContext.get().partitionId(), set(), 0

        def out() -> pa.RecordBatch:
            rare = [c for c in seen if c not in shipped.value]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), task, np.int32)), pa.array(rare, pa.string())], ["task", "chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for t in batch.column("text").slice(at, ROWS).to_pylist():
                    seen.update(chunks_of(t or ""))
                    chars += len(t or "")
                    # so many characters were read, and the list holds no more
                    if len(seen) > LISTED or chars > LISTED_CHARS and (chars := sum(map(len, seen))) > LISTED_CHARS:
                        yield out()
                        seen, chars = set(), 0
        if seen:
            yield out()

    return each


def chunk_table(docs: DataFrame, model: bytes, shipped: Broadcast) -> str:
    """The folder of the table of distinct chunks: task, chunk, ids, a folder inside for each task.

    Each task lists its distinct chunks, so a chunk has a row for each task and
    no more; those that every task has at hand (shipped) are left out. Rows are
    put in order of the chunk, and each distinct chunk of the corpus is
    segmented once; its ids go back to the tasks that listed it. Texts and
    their ids are not shuffled.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_listed(shipped), "task int, chunk string")
    rows = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_segmented(model, "task"), "task int, chunk string, ids binary")
    path = new_path(docs.sparkSession, "chunks")
    rows.repartition("task").write.option("compression", "zstd").partitionBy("task").parquet(path)
    return path


def own_chunks(path: str, task: int) -> dict[str, bytes]:
    """chunk -> ids of the chunks that a task listed."""
    store, root = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(f"{root}/task={task}", allow_not_found=True))
    table: dict[str, bytes] = {}
    for file in files:
        if file.path.endswith(".parquet"):
            with store.open_input_file(file.path) as source:
                for batch in parquet.ParquetFile(source).iter_batches(columns=["chunk", "ids"]):
                    table.update(zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), strict=True))
    return table


def encode_decode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: one row per row, whole texts.

    Null texts count as empty: an end id alone. Where a model's pieces can't
    cross a chunk's border, each distinct chunk is segmented once: the frequent
    ones go to every task, others by chunk_table() to the tasks that have them.
    A task that reads the texts a second time joins ids by their position. If a task then reads other texts than the one of its
    number did at first, as after a shuffle that is planned anew, it segments
    the chunks it misses itself; ids are the same.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    rows = columns(docs, doc_id=doc_id, text=text)
    by_chunk = codec(model).by_chunk
    shipped = docs.sparkSession.sparkContext.broadcast(frequent_chunks(rows, model) if by_chunk else {})
    path = chunk_table(rows, model, shipped) if by_chunk else None

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        table = shipped.value | own_chunks(path, TaskContext.get().partitionId()) if path else {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [c.encode(t or "", table) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                arrays = [part.column("doc_id"), pa.ListArray.from_arrays(ends, np.concatenate(ids)), pa.array([c.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(each, f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>, decoded string")
