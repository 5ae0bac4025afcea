"""Token ids in Arrow files of equal-length sequences.

A data set is a folder.  Its documents, in ascending id order, are one stream of token ids in which every document ends with
``end_id``.  The stream is dealt by ranges of ids over parts; each part is one Arrow IPC file (the random-access file form of
Arrow's stream format) of record batches with two fixed-size-list columns, ``ids`` and ``mask`` (true for ids of the stream,
false for the padding of a part's last sequence), and one small Arrow file that lists the part's documents.  A Parquet
manifest names the parts, so files of lost or repeated task attempts are never read.  Sequences are read by memory map:
batches hold equally many sequences, hence sequence ``i`` is a slice at a known place and nothing is copied.

Tasks write under a name of their own attempt and then move the file to its final name, which holds the same bytes whichever
attempt wins.  ``folder`` must be on a file system that pyarrow can open on all executors.

Edge cases: a null or empty text is a document of ``end_id`` only; rows without id come first; rows of one id are ordered by
a hash of their text, then by their place in the input, so a frequent id is spread over parts; a very long text is one row
of ids; an empty table gives an empty data set; columns other than id and text are not stored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts are encoded in parts of about so many bytes.
PART_BYTES = 4 << 20
MANIFEST = "part int, n_docs long, n_tokens long, n_sequences long"
#: White space by any reading of the word (a space next to it may belong to its piece).
_WHITE = r"\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000} "
_JOINED_SPACE = f"[{_WHITE}] | [{_WHITE}]"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words that do not both begin and end with a visible character.
_EDGE = f"^[{_WHITE}]|[{_WHITE}]$|^$"


class CachedTokenizer:
    """Token ids of texts by the ``tokenizers`` library, with the ids of short pieces kept.

    The pre-tokenizer of byte-level BPE ends a piece before a space that stands between two visible characters, and merges
    never cross pieces, so the ids of a text are those of its parts between such spaces, one after another.  For the same
    reason all unknown pieces of some texts can be encoded as one text: as a token of byte-level BPE says how many bytes it
    stands for, its ids fall apart into those of the pieces.  Kept words lie in one Arrow array and are looked up by Arrow;
    when there would be more than ``cached`` of them, those of the last texts take their place.  The few other pieces (a
    text's first word, pieces with joined white space) are in two generations of at most ``other``: when the young one is
    full, it takes the place of the old one.
    """

    def __init__(self, path: str, end_id: int, cached: int = 600_000, other: int = 100_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(max(vocabulary.values()), end_id) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes_of = np.zeros(size, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)  # byte-level tokens are written with one character for each byte
        self.end_id = end_id
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cached, self.other, self.longest = cached, other, longest
        self.words, self.ids, self.widths = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def _packed(self, ids) -> bytes:
        return np.asarray(ids, np.int64).astype(self.dtype).tobytes()

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _together(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that begin and end with a visible character, each led by a space, and how many each has."""
        joined = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(np.asarray(pc.binary_length(words)) + 1, dtype=np.int64)
        stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        return ids.astype(self.dtype), np.diff(stops, prepend=0)

    def _spaced(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Some ids, and where among them those of distinct words (as ``_together`` takes them) start, and how many each has."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        new = np.nonzero(place < 0)[0]
        ids, widths = self.ids, self.widths
        if len(new):
            place[new] = len(widths) + np.arange(len(new))
            fresh = words.take(pa.array(new))
            ids, widths = map(np.concatenate, zip((ids, widths), self._together(fresh)))
            starts = np.cumsum(widths) - widths
            known = pa.concat_arrays([self.words, fresh])
            keep = pc.less_equal(pc.binary_length(known), self.longest)
            if len(known) > self.cached:
                here = np.zeros(len(known), bool)
                here[place] = True
                keep = pc.and_(keep, pa.array(here))
            kept = np.asarray(keep)
            self.words, self.widths = known.filter(keep), widths[kept]
            self.ids = ids[_ragged(starts[kept], self.widths)]
        return ids, (np.cumsum(widths) - widths)[place], widths[place]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, each on its own."""
        out = {p: ids for p in pieces if (ids := self.young.get(p) or self.old.get(p)) is not None}
        new = [p for p in pieces if p not in out]
        out.update(zip(new, self._alone(new)))
        self.young.update((p, ids) for p, ids in out.items() if len(p) <= self.longest)
        if len(self.young) > self.other:
            self.young, self.old = {}, self.young
        return [out[p] for p in pieces]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after another, and their counts."""
        odd = np.asarray(pc.match_substring_regex(texts, _JOINED_SPACE))
        plain = texts.filter(pa.array(~odd))
        split = pc.split_pattern(plain, " ")
        cuts = np.asarray(split.offsets, dtype=np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        numbers = np.asarray(coded.indices, dtype=np.int64)
        firsts = cuts[:-1]  # a text's first word has no space before it
        lead = pc.take(coded.dictionary, pa.array(numbers[firsts])).dictionary_encode()
        leading = lead.dictionary.to_pylist()
        odd_pieces = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        known = dict.fromkeys(p for ps in odd_pieces for p in ps)
        spaced = [p for p in known if p[:1] == " " and not p[1:2].isspace() and not p[-1].isspace()]
        words = pa.concat_arrays([coded.dictionary, pa.array([p[1:] for p in spaced], pa.string())])
        known.update(zip(spaced, range(len(coded.dictionary), len(words))))
        edge = np.asarray(pc.match_substring_regex(words, _EDGE))
        alone = [f" {w}" for w in words.filter(pa.array(edge)).to_pylist()]
        rest = [p for p, number in known.items() if number is None]
        # the end of a text is a piece of its own
        packed = [*self.pieces(alone), *self.pieces(leading), self._packed([self.end_id]), *self.pieces(rest)]
        ids, spaced_starts, spaced_widths = self._spaced(words.filter(pa.array(~edge)))
        other_widths = np.array([len(p) for p in packed], np.int64) // self.dtype.itemsize
        other_starts = len(ids) + np.cumsum(other_widths) - other_widths
        flat = np.concatenate([ids, np.frombuffer(b"".join(packed), self.dtype)])
        # pieces by number: words, first words, the end, other pieces of odd texts
        starts_of, widths_of = (np.concatenate([np.zeros(len(words), np.int64), x[len(alone):]]) for x in (other_starts, other_widths))
        inner = np.nonzero(~edge)[0]
        starts_of[inner], widths_of[inner] = spaced_starts, spaced_widths
        starts_of[np.nonzero(edge)[0]], widths_of[np.nonzero(edge)[0]] = other_starts[:len(alone)], other_widths[:len(alone)]
        end = len(words) + len(leading)
        known.update(zip(rest, range(end + 1, end + 1 + len(rest))))
        numbers[firsts] = len(words) + np.asarray(lead.indices, dtype=np.int64)
        sizes = np.diff(cuts)
        pieces_in = np.zeros(len(texts), np.int64)
        pieces_in[~odd] = sizes
        pieces_in[odd] = [len(ps) for ps in odd_pieces]
        starts = np.cumsum(pieces_in + 1) - pieces_in - 1
        order = np.full(int(pieces_in.sum()) + len(texts), end, np.int64)
        for rows, values, counts in (
            (~odd, numbers, sizes), (odd, np.array([known[p] for ps in odd_pieces for p in ps], np.int64), pieces_in[odd]),
        ):
            order[_ragged(starts[rows], counts)] = values
        ordered = widths_of[order]
        totals = np.concatenate([[0], np.cumsum(ordered)])
        return flat[_ragged(starts_of[order], ordered)], totals[starts + pieces_in + 1] - totals[starts]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``counts[i]`` numbers each, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


_ENCODERS: dict[tuple[str, int], CachedTokenizer] = {}


def _encoder(path: str, end_id: int) -> CachedTokenizer:
    """One tokenizer for all tasks of a Python worker, so that its known pieces serve the next task too."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = CachedTokenizer(path, end_id)
    return _ENCODERS[path, end_id]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = re.sub("^file:/*", "/", folder)
    if folder.startswith("/"):
        return pafs.LocalFileSystem(use_mmap=True), folder.rstrip("/")
    system, path = pafs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


class SequenceWriter:
    """One part: sequences of ``length`` ids, ``per_batch`` of them in each record batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, per_batch: int):
        self.dtype, self.length, self.per_batch = dtype, length, per_batch
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema(
            [pa.field("ids", pa.list_(item, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)],
            metadata={"sequences_per_batch": str(per_batch)},
        )
        self.file = pa.ipc.new_file(sink, self.schema)
        self.waiting, self.bytes, self.sequences = [], 0, 0
        self.full = length * per_batch * dtype.itemsize

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        if self.bytes >= self.full:
            joined = b"".join(self.waiting)
            whole = len(joined) // self.full * self.full
            for at in range(0, whole, self.full):
                self._write(np.frombuffer(joined, self.dtype, self.full // self.dtype.itemsize, at), 0)
            self.waiting, self.bytes = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray, padding: int) -> None:
        mask = np.ones(len(ids) + padding, bool)
        mask[len(ids):] = False
        if padding:
            ids = np.concatenate([ids, np.zeros(padding, self.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        if self.bytes:
            ids = np.frombuffer(b"".join(self.waiting), self.dtype)
            self._write(ids, -len(ids) % self.length)
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one part; ids and masks are views of the mapped file."""

    def __init__(self, folder: str, part: int):
        system, path = _open(folder)
        self.reader = pa.ipc.open_file(system.open_input_file(f"{path}/part-{part:06d}.arrow"))
        self.per_batch = int(self.reader.schema.metadata[b"sequences_per_batch"])
        batches = self.reader.num_record_batches
        self.size = (batches - 1) * self.per_batch + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < self.size:
            raise IndexError(i)
        batch = self.reader.get_batch(i // self.per_batch)
        ids, mask = (batch.column(c)[i % self.per_batch].values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def stream(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the part's stream from ``start`` on; a view if they lie in one batch."""
        length, out = self.reader.schema.field("ids").type.list_size, []
        while n:
            batch, at = divmod(start, self.per_batch * length)
            ids = self.reader.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)[at:at + n]
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint32)])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", length: int = 1024, per_batch: int = 256,
    file_bytes: int = 32 << 20,
) -> None:
    """Write the token ids of all rows of ``docs`` below ``folder``.

    A part takes about ``file_bytes`` of text, so parts grow in number, not in size.  ``tokenizer`` is a byte-level BPE file
    that every executor can read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    order = ["id", "tie", "place"]
    placed = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(max(1, math.ceil(size / file_bytes)), *order).sortWithinPartitions(*order).select("id", "text")
    id_type = to_arrow_type(dealt.schema["id"].dataType)
    system, path = _open(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        system, path = _open(folder)
        final = f"{path}/part-{task.partitionId():06d}"
        mine = f"{final}.{task.taskAttemptId()}"
        encoder = _encoder(tokenizer, end_id)
        listed = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        docs_seen = start = 0
        with system.open_output_stream(f"{mine}.arrow") as ids_out, system.open_output_stream(f"{mine}.docs.arrow") as docs_out:
            sequences, index = SequenceWriter(ids_out, encoder.dtype, length, per_batch), pa.ipc.new_file(docs_out, listed)
            while first is not None:
                counts, texts, at = [], first.column(1), 0
                filled = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
                while at < len(texts):
                    stop = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + PART_BYTES)))
                    ids, n = encoder.encode(texts[at:stop])
                    sequences.add(ids.tobytes())
                    counts.append(n)
                    at = stop
                counts = np.concatenate(counts)
                ends = start + np.cumsum(counts)
                index.write_batch(pa.record_batch([first.column(0).cast(id_type), pa.array(ends - counts), pa.array(counts)], schema=listed))
                docs_seen, start = docs_seen + len(counts), int(ends[-1])
                first = next((b for b in batches if b.num_rows), None)
            sequences.close()
            index.close()
        for kind in (".docs.arrow", ".arrow"):
            system.move(mine + kind, final + kind)
        yield pa.record_batch([
            pa.array([task.partitionId()], pa.int32()), *(pa.array([n], pa.int64()) for n in (docs_seen, start, sequences.sequences))
        ], names=["part", "n_docs", "n_tokens", "n_sequences"])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str, id_type: T.DataType, id_col: str = "doc_id", out_bytes: int = 4 << 20) -> DataFrame:
    """One row per document of a data set: ``id_col``, ``start long`` (ids of the whole stream before it), ``n_tokens long``
    and ``ids binary`` (little-endian unsigned 32-bit numbers, with the end id)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = manifest.count()
    # one short row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, first in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                sequences = SequenceFile(folder, part)
                system, path = _open(folder)
                index = pa.ipc.open_file(system.open_input_file(f"{path}/part-{part:06d}.docs.arrow"))
                for number in range(index.num_record_batches):
                    listed = index.get_batch(number)
                    starts, counts = (listed.column(c).to_numpy() for c in (1, 2))
                    at, filled = 0, np.cumsum(counts) * 4
                    while at < len(starts):
                        stop = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + out_bytes)))
                        ids = [sequences.stream(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts[at:stop], counts[at:stop])]
                        yield pa.record_batch([listed.column(0)[at:stop], pa.array(starts[at:stop] + first), listed.column(2)[at:stop], pa.array(ids, pa.binary())], schema=arrow)
                        at = stop

    return offsets.repartition(max(1, parts)).mapInArrow(run, schema)
