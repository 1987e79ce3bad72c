"""Encoding of a whole corpus with a byte-level BPE, ids as the public tokenizer gives them.

Two passes. The first counts the words of all texts (each task adds up its own before the shuffle) and compiles the
most frequent ones with their ids into a minimal acyclic transducer, a file of bounded size that every worker maps into
memory. The second looks words up there and merges exactly those that it doesn't hold.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe
from loomspark.llm.lexicon import Lexicon, compile_lexicon
from loomspark.session import cut_lineage, shared_dir, spread

#: Words that the lexicon holds, and the longest of them in bytes. Both only bound its size: other words are merged.
LEXICON_WORDS = 50_000
LEXICON_BYTES = 48
_FLUSH = 200_000
_WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for chunk, n in chunks.items():
            for w in bpe.fine(chunk):
                words[w] += n
        chunks.clear()
        kept = [(b, n) for w, n in words.items() if len(b := w.encode("utf-8", "surrogatepass")) <= LEXICON_BYTES]
        for i in range(0, len(kept), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept[i : i + 50_000]], pa.binary()), pa.array([n for _, n in kept[i : i + 50_000]], pa.int64())], schema=_WORDS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                chunks.update(bpe.coarse(text))
                if len(chunks) > _FLUSH:
                    yield from flush()
    yield from flush()


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word BINARY, n``: how often each pretoken of up to ``LEXICON_BYTES`` bytes occurs in all texts."""
    return texts.select(column).mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, words: int) -> list[bytes]:
    """The words that occur most often, about ``words`` of them and never more, in byte order.

    How often a word must occur is read off a histogram of the counts in steps of 2 per cent, some hundred rows. Only words
    from there on go to the driver, so what it gets doesn't grow with the number of tasks. Within the last step, where
    some fit and some don't, none are taken.
    """
    step = F.floor(F.log("n") / F.log(F.lit(1.02))).cast("int")
    sizes = sorted(((r.step, r.k) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    room, least = words, None
    for at, k in sizes:
        if k > room:
            break
        room, least = room - k, at
    if least is None:
        return []
    return sorted(counts.filter(step >= least).select("word").toArrow().column(0).to_pylist())


def build_lexicon(texts: DataFrame, vocabulary: bpe.Vocabulary, column: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the most frequent words that occur more than once."""
    counts = cut_lineage(word_counts(texts, column).filter("n > 1"))
    return compile_lexicon((w, vocabulary.merge(w)) for w in frequent_words(counts, words))


def share_file(spark: SparkSession, data: bytes, stem: str) -> str:
    """Puts bytes into the shared folder and names them to all executors, also those that join later."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    name = f"{stem}-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark), name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(data))
    out.close()
    fs.deleteOnExit(path)
    sc.addFile(fs.makeQualified(path).toString())
    return name


class Encoder(dict):
    """Ids by chunk, found when a chunk is first seen; holds no more than ``CACHE_ENTRIES``."""

    def __init__(self, vocabulary: bpe.Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon, self.words = vocabulary, lexicon, {}

    def word(self, w: str) -> list[int]:
        """Ids of one pretoken: from the lexicon, else by exact merges."""
        if (made := self.words.get(w)) is not None:
            return made
        raw = w.encode("utf-8", "surrogatepass")
        made = self.lexicon.get(raw) if self.lexicon and len(raw) <= LEXICON_BYTES else None
        if made is None:
            made = self.vocabulary.merge(raw)
        if len(w) <= bpe.CACHE_CHARS:
            if len(self.words) >= bpe.CACHE_ENTRIES:
                self.words.clear()
            self.words[w] = made
        return made

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        made = tuple(chain.from_iterable(map(self.word, bpe.fine(chunk))))
        if len(chunk) <= bpe.CACHE_CHARS:
            if len(self) >= bpe.CACHE_ENTRIES:
                self.clear()
            self[chunk] = made
        return made

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null or empty."""
        return list(chain.from_iterable(map(self.__getitem__, bpe.coarse(text)))) if text else []


def encode_corpus(texts: DataFrame, model: str = "byte_bpe_50k", column: str = "text", folder: str = bpe.TOKENIZER_DIR, words: int = LEXICON_WORDS) -> DataFrame:
    """Adds ``ids ARRAY<INT>``: the text under ``model`` without special tokens, whose strings are ordinary text here.

    Null and empty texts have an empty list. Texts are encoded whole; every row stays, repeated ones too. A column named
    ``ids`` in the input is replaced, others stay.
    """
    spark = texts.sparkSession
    texts = spread(texts)
    vocabulary = bpe.vocabulary(model, folder)
    name = share_file(spark, build_lexicon(texts, vocabulary, column, words), "lexicon")
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def encode(rows: pa.Array) -> pa.Array:
        encoder = bpe.local(name, shared.value, lambda v: Encoder(v, Lexicon(SparkFiles.get(name))))
        get, coarse = encoder.__getitem__, bpe.coarse
        flat: list[int] = []
        offsets = [0]
        for text in rows.to_pylist():
            if text:
                flat.extend(chain.from_iterable(map(get, coarse(text))))
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return texts.withColumn("ids", encode(F.col(column)))
