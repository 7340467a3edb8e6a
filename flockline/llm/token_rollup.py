"""Token counts: rollups maintained by deltas.

Totals by source, language and tokenizer version are sums of signed contributions: an insert adds a
document's count, a delete takes it back, a revised count takes the old and adds the new.  A batch
of deltas is reduced to one row a group and written to a folder of its attempt's own; a marker, a
small file named after the batch that names the attempt, commits it.  Only marked folders are read,
and a marker names one attempt, so a batch counts once however often and by however many writers it
is sent: a rename of a file that must not exist yet decides where the file system has one, and the
last marker wins where it has not.  Reruns after a lost executor or driver change nothing.

Totals are the sum over the last compacted base and the marked batches that it doesn't hold.  Both
come from one listing, which is repeated if a new base appeared meanwhile; a batch that is committed
during a compaction is in no base yet and counts as itself.

Counts come from a tokenizer of the public vocabularies, whose files are a parameter; nothing is
trained.  Null source and language are groups of their own.
"""

from __future__ import annotations

import base64
import os
import time
from collections.abc import Callable
from urllib.parse import quote, unquote
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as kn
from ._session import ship

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
VOCABULARIES = os.environ.get("FLOCKLINE_TOKENIZERS", "/opt/tokenizers")
WORDS = "words-1"
#: The split pattern of byte-level BPE vocabularies of 50k entries, a fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(vocabulary: bytes):
    """A tiktoken encoding from the content of a vocabulary file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _counter(tokenizer: str, vocabulary: bytes | None):
    """Reads the vocabulary from bytes that were shipped: executors need no such file."""

    def run(batches):
        encoding = None if vocabulary is None else _encoder(vocabulary.value)
        for batch in batches:
            if encoding is None:
                n = np.zeros(batch.num_rows, np.int64)
                data, offsets = kn.flat_text(batch.column("text"))
                for a, b in kn.chunks(offsets):
                    n[a:b] = np.diff(kn.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2])
            else:
                n = np.array([len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column("text")], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([tokenizer] * batch.num_rows, pa.string()), pa.array(n), batch.column("n_chars")], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_chars"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars of each row of docs.

    vocabulary: a file of ranks; without it, tokens are runs of anything but the six ASCII
    separators.

    Defined cases: null and empty texts have no tokens; a null doc_id, source or lang stays null;
    rows that share a doc_id are counted each; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    shared = None
    if vocabulary is not None:
        with open(vocabulary, "rb") as f:  # one file of a few MB
            shared = docs.sparkSession.sparkContext.broadcast(f.read())
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), text.alias("text"))
    return slim.mapInArrow(_counter(tokenizer, shared), "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace old counts of documents by new ones."""
    return deletes(old).unionByName(inserts(new))


class RollupStore:
    """Committed batches under one folder of a file system that all executors share.

    attempts/<uuid>: data; batches/<id>, held/<id> and bases/<number>: markers that name an attempt.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, kind: str) -> list[str]:
        top = self._at(f"{self.path}/{kind}")
        return sorted(unquote(s.getPath().getName()[2:]) for s in self._fs.listStatus(top) if s.getPath().getName().startswith("m-")) if self._fs.exists(top) else []

    def _marker(self, kind: str, name: str):
        return self._at(f"{self.path}/{kind}/m-{quote(name, safe='')}")

    def _attempt(self, kind: str, name: str) -> str:
        """The attempt that a marker names."""
        stream = self._fs.open(self._marker(kind, name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, write: Callable[[str], None], kind: str, name: str) -> bool:
        """Write an attempt and mark it; false if the marker is there or another writer was first."""
        marker = self._marker(kind, name)
        if self._fs.exists(marker):
            return False
        attempt = uuid4().hex
        write(f"{self.path}/attempts/{attempt}")
        draft = self._at(f"{self.path}/attempts/{attempt}.marker")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(attempt, "ascii"))
        stream.close()
        self._fs.mkdirs(marker.getParent())
        done = not self._fs.exists(marker) and self._fs.rename(draft, marker) and self._attempt(kind, name) == attempt
        if not done:
            self._fs.delete(draft, False)
            self._fs.delete(self._at(f"{self.path}/attempts/{attempt}"), True)
        return done

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """The current base, and of the batches not yet vacuumed those that it doesn't hold and those that it does."""
        while True:
            bases = self._names("bases")
            base = bases[-1] if bases else None
            marked = self._names("batches")
            if self._names("bases") == bases:
                break
        if base is None:
            return None, marked, []
        # as many as were committed between two vacuums
        held = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/attempts/{self._attempt('bases', base)}/held").toLocalIterator()}
        return base, [b for b in marked if b not in held], [b for b in marked if b in held]

    def batches(self) -> list[str]:
        """Ids of all batches ever committed."""
        return sorted({*self._names("batches"), *self._names("held")})

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas (GROUP, n_tokens, n_chars, sign); false, and no change, if it is there.

        Rows with a null n_tokens or sign count as nothing.
        """
        if "/" in batch or not batch:
            raise ValueError("a batch id is a name without slashes")
        if self._fs.exists(self._marker("batches", batch)) or self._fs.exists(self._marker("held", batch)):
            return False
        signed = deltas.where("n_tokens is not null and sign is not null")
        sums = [F.sum("sign").cast("long").alias("n_docs"), *[F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in SUMS[1:]]]
        return self._publish(lambda to: signed.groupBy(*GROUP).agg(*sums).write.parquet(to), "batches", batch)

    def _sums(self, base: str | None, live: list[str]) -> DataFrame:
        paths = [f"{self.path}/attempts/{self._attempt('batches', b)}" for b in live]
        paths += [f"{self.path}/attempts/{self._attempt('bases', base)}/totals"] if base else []
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        # groupBy takes nulls as one group
        sums = rows.groupBy(*GROUP).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def totals(self) -> DataFrame:
        """The totals by group; groups whose documents are all gone are left out."""
        base, live, _ = self._state()
        return self._sums(base, live)

    def compact(self) -> bool:
        """Fold the batches committed by now into a new base; false if another compaction was first."""
        base, live, held = self._state()

        def write(at: str) -> None:
            self._sums(base, live).write.parquet(f"{at}/totals")
            self.spark.createDataFrame([(n,) for n in live + held], "batch string").write.parquet(f"{at}/held")

        return self._publish(write, "bases", f"{(int(base) if base else 0) + 1:09d}")

    def vacuum(self, older: float = 86_400) -> None:
        """Delete the data of batches that the current base holds, older bases, and attempts
        without a marker that are older than so many seconds.  The ids stay known.

        Readers of an older base may fail and must be repeated.
        """
        base, live, held = self._state()
        self._fs.mkdirs(self._at(f"{self.path}/held"))
        for b in held:
            gone = self._at(f"{self.path}/attempts/{self._attempt('batches', b)}")
            self._fs.rename(self._marker("batches", b), self._marker("held", b))
            self._fs.delete(gone, True)
        for b in self._names("bases"):
            if b != base:
                self._fs.delete(self._at(f"{self.path}/attempts/{self._attempt('bases', b)}"), True)
                self._fs.delete(self._marker("bases", b), False)
        used = {self._attempt("bases", base)} if base else set()
        top, now = self._at(f"{self.path}/attempts"), time.time()
        for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = s.getPath().getName().split(".")[0]
            if s.getModificationTime() / 1000 <= now - older and name not in used:
                used |= {self._attempt("batches", b) for b in self._names("batches")}
                if name not in used:
                    self._fs.delete(s.getPath(), True)
