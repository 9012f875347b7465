"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back through memory maps.

One range of document ids is one part. A part is three little-endian files:

* ``part-NNNNN.ids``: the token ids of its documents one after the other, 16 bits wide if the vocabulary fits, else 32;
* ``part-NNNNN.off``: n_docs + 1 unsigned 64-bit positions, counted in ids from the part's start;
* ``part-NNNNN.doc``: the document ids, signed 64 bits (null ids come first in a part; the manifest has their number).

``manifest.json`` lists the parts in ascending order of document id with their bases, the prefix sums of the ids before them,
so any document is found with two reads. Files appear by a rename under a name that depends on the part alone, and their content
depends on the part's rows alone: a task that runs again after a lost executor writes the same bytes.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

END_ID = 2
#: A text may be cut before a space that stands between two of these characters: no token crosses such a place, as the byte-level
#: pre-tokenizer starts a new piece there whatever surrounds it.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
ODD = re.compile(r"[^!-~\w \n]")
#: Pieces that a worker remembers. Only speed depends on it.
REMEMBER = 800_000
#: A letter before one of these ends a piece as well.
STOPS = ".,;:!?"
#: Stands for a space at which a text is cut; a text that holds it is encoded as it is.
MARK = "\0"
PART = "part int, n_docs long, n_null_ids long, n_ids long, first_doc long"
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


class Encoder:
    """The tokenizers library with a bounded memory of pieces already encoded; gives ids as packed bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, bool)
        for piece, at in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[at] = piece.startswith("Ġ")
        kind = json.loads(self.tokenizer.to_str())
        pre, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
        whole = kind.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
        added = any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in kind.get("added_tokens", []))
        self.by_piece = not (whole or added)
        if self.by_piece:
            self.by_space = Tokenizer.from_file(path)
            self.by_space.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.stops = dict(zip(STOPS, self._packed(list(STOPS))))

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Encodes many pieces as one text; a piece without inner space begins where an id opens with a space."""
        known = self.known
        ended = {p for p in pieces if p and p[-1] in STOPS and p[-2:-1].isalpha()}
        need = (pieces - ended) | {p[:-1] for p in ended if p[:-1] not in known}
        letters = [p for p in need if p.isalpha()]  # one piece to the pre-tokenizer's pattern, which needn't be run
        plain = [p for p in need if not p.isalpha() and " " not in p]
        for tokenizer, some in [(t, x[k : k + 2000]) for t, x in ((self.by_space, letters), (self.tokenizer, plain)) for k in range(0, len(x), 2000)]:
            ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some):
                known.update(zip(some, self._packed([" " + p for p in some])))
                continue
            raw, w = ids.tobytes(), self.dtype.itemsize
            edge = (np.append(at, len(ids)) * w).tolist()
            known.update(zip(some, map(raw.__getitem__, map(slice, edge, edge[1:]))))
        if odd := [p for p in need if " " in p]:
            known.update(zip(odd, self._packed([" " + p for p in odd])))
        for p in ended:
            known[p] = known[p[:-1]] + self.stops[p[-1]]

    def _marked(self, text: str) -> str:
        """The text with MARK for each space at which it may be cut."""
        if "  " not in text and " \n" not in text and "\n " not in text and (text.replace("\n", "").isprintable() if text.isascii() else not ODD.search(text)):
            return text.replace(" ", MARK)  # each space then stands between two visible characters, or at an end
        return CUT.sub(MARK, text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Looks up the distinct pieces of all texts, and puts their ids together by array operations."""
        if not self.by_piece or any(MARK in t for t in texts):
            return self._packed(texts)
        if len(self.known) > REMEMBER:
            self.known.clear()
        parted = [self._marked(t).partition(MARK) for t in texts]
        first = self._packed([p[0] for p in parted])
        lists = pc.split_pattern(pa.array([p[2] if p[1] else None for p in parted], pa.large_string()), MARK)
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        pieces, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        packed = list(map(self.known.get, pieces))
        if missing := [k for k, x in enumerate(packed) if x is None]:
            self._learn({pieces[k] for k in missing})
            for k in missing:
                packed[k] = self.known[pieces[k]]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        each = size[code]
        after = np.cumsum(each)
        total = int(after[-1]) if len(after) else 0
        flat = np.frombuffer(b"".join(packed), self.dtype)
        at = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64  # half the memory to go through where places fit
        place = np.repeat((start[code] - after + each).astype(at), each)
        place += np.arange(total, dtype=at)
        ids = flat.take(place)
        edge = np.concatenate([[0], after])[offsets].tolist()
        return [a + ids[x:y].tobytes() for a, x, y in zip(first, edge, edge[1:])]


_ENCODERS: dict[str, Encoder] = {}
common.CACHES["token_files"] = lambda: [e.known.clear() for e in _ENCODERS.values()]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def filesystem(uri: str):
    """The file system and path of a URI; Spark's names of the S3 connector are those of the same store."""
    from pyarrow import fs

    scheme, rest = uri.split("://", 1) if "://" in uri else ("", uri)
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096, most: int = 6 << 20) -> Iterator[tuple[list, list]]:
    """Small runs of (doc ids, texts), by rows and by characters: the texts of one run are in memory at once."""
    for batch in batches:
        docs, column = batch.column("doc_id").to_pylist(), batch.column("text")
        k = 0
        while k < len(docs):
            run, held = [], 0
            while k + len(run) < len(docs) and len(run) < rows and held < most:
                run.append(column[k + len(run)].as_py() or "")
                held += len(run[-1])
            yield docs[k : k + len(run)], run
            k += len(run)


def write(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes ``text`` and writes the files under the folder ``out`` (a URI that the executors share); returns the manifest.

    A null or empty text has the end id alone. Rows with one doc_id keep the order of their texts, and each has its own entry;
    null ids come first. No rows: a manifest without parts. Other columns are not read.
    """
    spark = docs.sparkSession
    filesystem(out)[0].create_dir(filesystem(out)[1], recursive=True)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(common.shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        common.keep_only("token_files")
        enc = encoder(tokenizer_path)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        fs, root = filesystem(out)
        held, name = f"{root}/.{part:05d}-{attempt}", f"{root}/part-{part:05d}"
        sizes, ids, ids_file = [], [], None
        for docs, texts in _slices(batches):
            ids_file = ids_file or fs.open_output_stream(f"{held}.ids")
            packed = enc.encode(texts)
            sizes.append(np.fromiter((len(p) // width + 1 for p in packed), np.uint64, len(packed)))
            ids += docs
            ids_file.write(end.join([*packed, b""]))
        if ids_file is None:
            return
        ids_file.close()
        null = sum(d is None for d in ids)
        offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate(sizes), dtype=np.uint64)])
        for suffix, data in (("off", offsets.astype("<u8")), ("doc", np.array([0 if d is None else d for d in ids], "<i8"))):
            with fs.open_output_stream(f"{held}.{suffix}") as f:
                f.write(data.tobytes())
        for suffix in ("off", "doc", "ids"):
            _rename(fs, f"{held}.{suffix}", f"{name}.{suffix}")
        row = {"part": [part], "n_docs": [len(ids)], "n_null_ids": [null], "n_ids": [int(offsets[-1])], "first_doc": [ids[null] if null < len(ids) else None]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), *((k, pa.int64()) for k in list(row)[1:])]))

    parts = sorted(ordered.mapInArrow(encode, PART).collect(), key=lambda r: r.part)
    base, listed = 0, []
    for docs_before, r in zip(_sums(p.n_docs for p in parts), parts):
        listed.append(r.asDict() | {"base": base, "doc_base": docs_before})
        base += r.n_ids
    manifest = {"dtype": encoder(tokenizer_path).dtype.str, "end_id": end_id, "n_ids": base, "parts": listed}
    fs, root = filesystem(out)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _sums(counts) -> list[int]:
    total, out = 0, []
    for c in counts:
        out.append(total)
        total += c
    return out


def _rename(fs, a: str, b: str) -> None:
    try:
        fs.move(a, b)
    except OSError:  # stores that don't rename over a file of an earlier attempt
        fs.delete_file(b)
        fs.move(a, b)


def mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped on a local or mounted file system, else read."""
    info = fs.get_file_info(path)
    if info.size == 0:
        return np.empty(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, out: str) -> DataFrame:
    """A row for each document from the files: place of its first id among all ids, number of ids, crc32 of the ids as 32-bit."""
    fs, root = filesystem(out)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    parts, dtype = manifest["parts"], manifest["dtype"]
    if not parts:
        return spark.createDataFrame([], ROW)
    n = len(parts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            p = parts[k]
            name = f"{root}/part-{p['part']:05d}"
            ids, off, doc = mapped(fs, f"{name}.ids", dtype), mapped(fs, f"{name}.off", "<u8").astype(np.int64), mapped(fs, f"{name}.doc", "<i8")
            for lo in range(0, p["n_docs"], 5000):
                hi = min(lo + 5000, p["n_docs"])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist())]
                null = np.arange(lo, hi) < p["n_null_ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(doc[lo:hi]), mask=null), pa.array(off[lo:hi] + p["base"]), pa.array(np.diff(off[lo : hi + 1])), pa.array(crc, pa.int64()), pa.array([p["part"]] * (hi - lo), pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )

    return spark.range(0, n, 1, n).mapInArrow(digest, ROW)


def token_files(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files of ``docs`` and returns what is read back from them (see ``read``)."""
    out = out or common.scratch(docs.sparkSession, "token-ids")
    write(docs, out, tokenizer_path, end_id)
    return read(docs.sparkSession, out)
