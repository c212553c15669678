"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthtab.llm.common import pick

# Lengths of the n-grams, and the number of buckets they are hashed to.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SMOOTHING = 0.5
# Bound of the training sample: about so many documents of each language.
SAMPLE_PER_LANGUAGE = 2000
# Bound of the matrix that is broadcast: BUCKETS * MOST_LANGUAGES numbers of four bytes.
MOST_LANGUAGES = 256
UNDETERMINED = "und"
_SLICE_CHARS = 2_000_000
_SPACE = 32
_SAMPLE_PARTS = 1_000_000


class NGrams:
    """Hashed n-grams of lower-cased letters; every run of other characters is one space."""

    def __init__(self) -> None:
        codes = np.arange(0x110000)
        self._letter = np.fromiter((chr(c).isalpha() for c in codes), bool, len(codes))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all n-grams, the text each belongs to, and whether a text has letters.

        Texts are in order; buckets of one text are contiguous for each order only.
        """
        lowered = [f" {t.lower()} " for t in texts]
        joined = "".join(lowered).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, "<u4")
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        letter = self._letter[codes]
        codes = np.where(letter, codes, _SPACE).astype(np.uint32)
        first = np.ones(len(codes), bool)
        first[1:] = owner[1:] != owner[:-1]
        keep = letter | first
        keep[1:] |= letter[:-1]
        codes, owner, letter = codes[keep], owner[keep], letter[keep]
        has_letters = np.zeros(len(texts), bool)
        has_letters[owner[letter]] = True
        grams, owners = [], []
        for order in ORDERS:
            if len(codes) < order:
                continue
            size = len(codes) - order + 1
            value = np.full(size, order, np.uint32)
            for k in range(order):
                value = (value ^ codes[k : k + size]) * np.uint32(0x9E3779B1)
                value ^= value >> np.uint32(15)
            whole = owner[:size] == owner[order - 1 :]
            if order == 1:
                whole &= letter
            grams.append((value % np.uint32(BUCKETS))[whole])
            owners.append(owner[:size][whole])
        return grams, owners, has_letters


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_SLICE_CHARS`` characters, one text at least."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= _SLICE_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def _count_schema() -> str:
    return "lang string, bucket int, n long"


def fit(
    labelled: DataFrame,
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    id_column="doc_id",
    text_column="text",
    lang_column="lang",
) -> LanguageModel | None:
    """Learn from rows with a language and a text; None if there are none.

    Of each language about ``sample_per_language`` rows are used, chosen by a hash of the
    identifier. N-grams are counted in the tasks; the driver sees one number per
    language and bucket.
    """
    rows = pick(labelled, _id=id_column, _text=text_column, _lang=lang_column).where(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull()
    )
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    limit = F.lit(0)
    for lang, size in sizes.items():
        share = min(1.0, sample_per_language / size)
        limit = F.when(F.col("_lang") == lang, F.lit(round(share * _SAMPLE_PARTS))).otherwise(limit)
    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(_SAMPLE_PARTS)) < limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams, totals = NGrams(), {}
        for batch in batches:
            texts, langs = batch["_text"].to_pylist(), batch["_lang"].to_pylist()
            for start, stop in _slices(texts):
                grams, owners, _ = ngrams(texts[start:stop])
                names = langs[start:stop]
                for name in set(names):
                    mine = np.fromiter((x == name for x in names), bool, len(names))
                    found = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for g, o in zip(grams, owners, strict=True):
                        found += np.bincount(g[mine[o]], minlength=BUCKETS)
        for name, found in totals.items():
            filled = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * len(filled), "bucket": filled.astype(np.int32), "n": found[filled]}
            )

    counted = (
        sample.select("_text", "_lang")
        .mapInArrow(count, _count_schema())
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = tuple(sorted(counted["lang"].unique()))
    if not languages:
        return None
    column = counted["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy()
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[counted["bucket"].to_numpy(), column] += counted["n"].to_numpy()
    sizes_in_order = np.array([sizes[name] for name in languages], float)
    return LanguageModel(
        languages,
        np.log(counts / counts.sum(axis=0)).astype(np.float32),
        np.log(sizes_in_order / sizes_in_order.sum()),
    )


def predict(
    docs: DataFrame, model: LanguageModel | None, id_column="doc_id", text_column="text"
) -> DataFrame:
    """Language and score of every text: columns of the identifier, ``lang_pred``, ``score``.

    The score is the posterior probability of the language. A text that is null or has no
    letters is ``und`` with score 0, as is every text if there is no model. Whole texts are
    used, of any length. Of languages with equal scores the first by name wins. Rows with
    equal identifiers stay rows of their own; extra columns are not read.
    """
    rows = pick(docs, _id=id_column, _text=text_column)
    kind = rows.schema["_id"].dataType
    if model is None:
        return rows.select(
            F.col("_id").alias(id_column),
            F.lit(UNDETERMINED).alias("lang_pred"),
            F.lit(0.0).alias("score"),
        )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams, known = NGrams(), sent.value
        names = np.array([*known.languages, UNDETERMINED], object)
        for batch in batches:
            texts = [t or "" for t in batch["_text"].to_pylist()]
            best, certain = [], []
            for start, stop in _slices(texts):
                grams, owners, has_letters = ngrams(texts[start:stop])
                total = np.tile(known.log_prior, (stop - start, 1))
                for g, o in zip(grams, owners, strict=True):
                    if len(g):
                        # Sparse rows: the n-grams of a text are a run of equal owners.
                        runs = np.flatnonzero(np.diff(o, prepend=-1))
                        total[o[runs]] += np.add.reduceat(known.log_prob[g], runs, axis=0)
                total -= total.max(axis=1, keepdims=True)
                share = np.exp(total)
                share /= share.sum(axis=1, keepdims=True)
                top = share.argmax(axis=1)
                certain.append(np.where(has_letters, share[np.arange(len(top)), top], 0.0))
                best.append(np.where(has_letters, top, len(known.languages)))
            picked = np.concatenate(best) if best else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"],
                    pa.array(names[picked], pa.string()),
                    pa.array(np.concatenate(certain) if certain else [], pa.float64()),
                ],
                names=[id_column, "lang_pred", "score"],
            )

    return rows.mapInArrow(
        score, f"`{id_column}` {kind.simpleString()}, lang_pred string, score double"
    )


def held_out(crc: Column) -> Column:
    """Rows kept from training: the checksum of the identifier is 2 modulo 4."""
    return F.coalesce(crc % 4 == 2, F.lit(False))
