"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

Documents are range-partitioned and sorted by id, so that the files in order of their number
hold all ids in ascending order of doc_id. Each task tokenizes its range and writes, per part,
    part-NNNNNN.ids  the token ids, little-endian, 16 bits wide if the vocabulary allows, else 32
    part-NNNNNN.off  n + 1 offsets into .ids, unsigned 64-bit, in tokens
    part-NNNNNN.doc  n document ids, signed 64-bit
    part-NNNNNN.nul  n bytes, 1 where the document id is null
Files are written under a name of the attempt and renamed when whole, so a task that is run again
after a lost executor leaves the same files. Bases of the parts are prefix sums over one row a part.

Defined results: a null text is an empty one and holds the end id alone; null doc_ids come first;
repeated rows are written each time; rows that share a doc_id are ordered by text. An empty table
gives no parts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table


class Known(dict):
    """Ids by word; a word that is not known is taken from an older generation, or learnt."""

    def __init__(self, learn, older: Known | None = None):
        super().__init__()
        self.learn, self.older = learn, older
        if older is not None:
            older.older = None

    def __missing__(self, word: str) -> bytes:
        ids = None if self.older is None else self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


#: Longer pieces of text are not kept.
LONGEST = 64


class WordCache:
    """Token ids of a text from the ids of its words, which are kept; what is not certain goes to the tokenizer whole.

    Cutting at white space is exact for tokenizers whose pre-tokenizer never joins what stands on
    both sides of such a cut. Two kinds are known: "space" tokenizers mark a word by the space
    before it, "end" tokenizers drop white space. Words of Latin letters go to the BPE model
    itself, which saves the cost of an encoding's offsets.
    """

    #: Words kept in each of two generations; when the newer is full, the older is let go.
    MOST = 400_000
    #: Letters that every Unicode version calls letters, and marks that are neither letter, number nor apostrophe.
    LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@[-`{-~"
    PARTS = re.compile(f" ?[{LETTERS}]+| ?[{MARKS}]+|\n")
    #: Possessive, so that a long run that does not fit is given up at once.
    PLAIN = re.compile(f"(?: ?[{LETTERS}]++| ?[{MARKS}]++)(?:[{MARKS}]++|\n?[{LETTERS}]++|\n[{MARKS}]++)*+")
    #: Texts without any of these are cut by one pattern into what the pre-tokenizer makes of them.
    OTHER = re.compile(f"[^{LETTERS}{MARKS}0-9 \n]")
    TOGETHER = ("  ", " \n", "\n ", "\n\n\n", "<|")
    PIECES = {
        "space": re.compile(f" ?[{LETTERS}]+| ?[{MARKS}]+| ?[0-9]+|\n"),
        "end": re.compile(f"[{LETTERS}]+|[{MARKS}]+|[0-9]"),
    }

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.kind = self.tokenizer.model, kind
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = self.PIECES[kind].findall
        self.known, self.exact = Known(self.learn), Known(self.merge)
        self.code = "H" if self.type.itemsize == 2 else "I"
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, word: str) -> bytes:
        """The ids of what stands between two cuts at white space."""
        if "<|" in word or not self.PLAIN.fullmatch(word):
            return self.whole(word)
        return b"".join([self.exact[x] for x in self.PARTS.findall(word.lower() if self.kind == "end" else word)])

    def merge(self, piece: str) -> bytes:
        """The ids of one piece that the pre-tokenizer leaves whole, lower-cased if it does so."""
        spelled = piece.replace(" ", "Ġ") if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def ids(self, text: str) -> bytes:
        if len(self.known) > self.MOST:
            self.known = Known(self.learn, self.known)
        if len(self.exact) > self.MOST:
            self.exact = Known(self.merge, self.exact)
        if self.OTHER.search(text) or text[:1].isspace() or text[-1:].isspace() or any(x in text for x in self.TOGETHER):
            return b"".join(map(self.known.__getitem__, self.parts(text)))
        return b"".join(map(self.exact.__getitem__, self.pieces(text.lower() if self.kind == "end" else text)))

    def parts(self, text: str) -> list[str]:
        """Parts of text whose ids, one after the other, are those of text."""
        if self.kind == "end":
            return [text] if CONTROL.search(text) else text.split()
        if "  " in text or " \n" in text or text[:1].isspace() or text[-1:].isspace() or SPECIAL_SPACE.search(text):
            return self.by_line(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if text else []

    def by_line(self, text: str) -> list[str]:
        """Runs of words with one space between them, apart from the places where more white space stands."""
        out, at = [], 0
        for m in RUN.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()])
            out += re.findall(" ?[^ ]+", m[0])
            at = m.end()
        if at < len(text):
            out.append(text[at:])
        return out


CONTROL = re.compile("[\x1c-\x1f]")
SPECIAL_SPACE = re.compile("[^\\S \n]|[\x1c-\x1f]|\n ")
#: Words between single spaces, from a word that no white space touches on the left but a space of its own.
RUN = re.compile("(?<=[!-~]) [!-~]+(?: [!-~]+)*(?= [!-~])")

_caches: dict[tuple[str, str], WordCache] = {}


def cache(path: str, kind: str) -> WordCache:
    """One for each Python worker, kept from task to task."""
    if (path, kind) not in _caches:
        _caches[path, kind] = WordCache(path, kind)
    return _caches[path, kind]


def filesystem(folder: str):
    """The file system of a folder that driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(store, path: str, chunks: list[bytes]) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for x in chunks:
            out.write(x)
    store.move(own, path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, kind: str = "space") -> DataFrame:
    """Writes the files of docs (doc_id, text) and returns part, n_docs, n_tokens, base, width; one row a part."""
    spark = docs.sparkSession

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = filesystem(folder)
        words, part = None, None
        sizes, names, nulls = [0], [], []
        own = f"{top}/{uuid.uuid4().hex}.part"
        out = None
        for pdf in batches:
            if words is None:
                words = cache(tokenizer, kind)
                end = np.array([end_id], words.type).tobytes()
                part = int(pdf["part"].iloc[0])
                out = store.open_output_stream(own)
            names.append(pdf["doc_id"].to_numpy("<i8"))
            nulls.append(pdf["missing"].to_numpy("u1"))
            for text in pdf["text"]:
                ids = words.ids(text) + end
                out.write(ids)
                sizes.append(len(ids) // words.type.itemsize)
        if words is None:
            return
        out.close()
        base = f"{top}/part-{part:06d}"
        offsets = np.cumsum(np.array(sizes, "<u8"), dtype="<u8")
        _put(store, f"{base}.off", [offsets.tobytes()])
        _put(store, f"{base}.doc", [x.tobytes() for x in names])
        _put(store, f"{base}.nul", [x.tobytes() for x in nulls])
        store.move(own, f"{base}.ids")
        yield pd.DataFrame({"part": [part], "n_docs": [len(sizes) - 1], "n_tokens": [int(offsets[-1])], "width": [words.type.itemsize]})

    store, top = filesystem(folder)
    store.create_dir(top, recursive=True)
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text", F.spark_partition_id().alias("part"))
    )
    parts = ordered.mapInPandas(task, "part int, n_docs long, n_tokens long, width int").collect()  # one row a part
    rows = spark.createDataFrame([tuple(p) for p in parts], "part int, n_docs long, n_tokens long, width int")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


class View:
    """A file of numbers, memory-mapped where the folder is local; elsewhere only the range asked for is read."""

    def __init__(self, store, path: str, dtype: str):
        from pyarrow import fs

        self.dtype, self.mapped, self.file = np.dtype(dtype), None, None
        if isinstance(store, fs.LocalFileSystem):
            self.mapped = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.file is None:
            return np.asarray(self.mapped[span])
        lo, hi, _ = span.indices(self.file.size() // self.dtype.itemsize)
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


#: Documents and tokens read at once; a longer document is read alone.
READ_DOCS, READ_TOKENS = 2000, 1 << 22


def read(parts: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, and its ids if asked for."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = filesystem(folder)
        for pdf in batches:
            for p in pdf.itertuples():
                name = f"{top}/part-{p.part:06d}"
                ids, ends = View(store, f"{name}.ids", f"<u{p.width}"), View(store, f"{name}.off", "<u8")
                docs, nulls = View(store, f"{name}.doc", "<i8"), View(store, f"{name}.nul", "u1")
                lo = 0
                while lo < p.n_docs:
                    offsets = ends[lo : min(lo + READ_DOCS, p.n_docs) + 1].astype("i8")
                    n = max(1, int(np.searchsorted(offsets, offsets[0] + READ_TOKENS, "right")) - 1)
                    offsets = offsets[: n + 1]
                    held = ids[int(offsets[0]) : int(offsets[-1])].astype("<u4")
                    spans = [held[a:b] for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
                    found = pd.DataFrame(
                        {
                            "doc_id": docs[lo : lo + n],
                            "missing": nulls[lo : lo + n] > 0,
                            "start": offsets[:-1] + p.base,
                            "n_tokens": np.diff(offsets),
                            "ids_crc32": [zlib.crc32(x) for x in spans],
                        }
                    )
                    if with_ids:
                        found["ids"] = [x.astype("i8") for x in spans]
                    yield found
                    lo += n

    schema = "doc_id long, missing boolean, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = parts.repartition(spread, "part").mapInPandas(task, schema)
    return found.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


#: Fixed values of the query.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder, tokenizer, END_ID), folder)
