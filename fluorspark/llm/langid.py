"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in Spark tasks and sums them by (language, bucket) in one
aggregation. The log-probability matrix has ``buckets`` x languages cells, whatever
the size of the corpus, and is broadcast. A batch of documents becomes one sparse block (document, bucket, count in compressed
rows), which is multiplied by the matrix in numpy. Beyond ``BLOCK_LANGUAGES`` labels the matrix is cut into blocks of so many
columns, which lie in the shared folder: a task holds one of them at a time and keeps each document's best
language and sum of likelihoods so far, so the results are those of the whole matrix.

Defined results: a null text or one without a letter is ``und`` with score 0; rows with a
null id are scored too but never trained on; duplicates are scored row by row; an empty
table gives an empty result; without any labelled row every document is ``und``.
Columns other than the id, text and label are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fields, numbered, restored, slices, texts_of, with_new, work_folder

#: n-gram lengths, hash buckets, and the bound on the labelled sample: expected documents for each language.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MAX_TRAIN_DOCS_PER_LANG = 4000
SMOOTHING = 0.5
CHUNK = 1 << 18
#: Languages of a block of the matrix (64 MB at the default buckets), and the products of a sparse block that are held at once.
BLOCK_LANGUAGES = 256
BLOCK = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_)


def bucket_runs(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, a bounded run of characters at a time.

    Text is lower-cased and every other character counts as a blank; an n-gram counts if it
    ends in a letter.
    """
    code = np.frombuffer((" " + text.lower()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    back = max(ORDERS) - 1
    for begin in range(1, len(code), CHUNK):
        part = code[max(0, begin - back) : begin + CHUNK]
        known = _letters()[part]
        part = np.where(known, part, 32).astype(np.uint64)
        new = min(begin, back)
        for n in ORDERS:
            if len(part) < n:
                continue
            mixed = np.full(len(part) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ part[k : len(part) - n + 1 + k]
            mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
            ends = known[n - 1 :].copy()
            ends[: max(0, new - n + 1)] = False  # counted with the previous run
            yield (mixed[ends] % np.uint64(buckets)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def labelled(docs: DataFrame, text: str, label: str, train: object, most: int) -> DataFrame:
    """Labelled rows to learn from: a hash sample of about ``most`` documents for each language."""
    rows = docs.where(train & F.col(label).isNotNull() & F.col(text).isNotNull())
    # the id spreads the copies of a text; it only says whether a row is in the sample
    spread = F.xxhash64(*(c for c in ("doc_id", text) if c in docs.columns))
    rows = rows.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.pmod(spread, F.lit(1 << 20)).alias("part"))
    sizes = rows.groupBy("lang").count().collect()
    common = [r for r in sizes if r["count"] > most]
    if not common:
        return rows.drop("part")
    # rows of other languages are all in the sample
    share = F.create_map(*(x for r in common for x in (F.lit(r["lang"]), F.lit(most / r["count"]))))
    return rows.where(F.coalesce(F.col("part") < share[F.col("lang")] * (1 << 20), F.lit(True))).drop("part")


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", train=None, most: int = MAX_TRAIN_DOCS_PER_LANG, buckets: int = BUCKETS) -> dict:
    """A model: languages, log-priors and the log-probability matrix (buckets x languages) in blocks of columns, each one an array or, if there are several, a file's address."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in slices(batches):
            for lang, value in zip(texts_of(batch, "lang"), texts_of(batch, "text"), strict=True):
                total = seen.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + 1
                for run in bucket_runs(value, buckets):
                    total += np.bincount(run, minlength=buckets)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[docs_of[lang], total[at]])], names=["lang", "bucket", "n"])

    rows = cut(labelled(docs, text, label, F.lit(True) if train is None else train, most).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    known = rows.where("bucket < 0").toPandas().sort_values("lang")
    langs, priors = known["lang"].tolist(), known["n"].to_numpy(dtype=np.float64)
    begins = range(0, len(langs), BLOCK_LANGUAGES)
    folder = work_folder(docs.sparkSession, "languages") if len(begins) > 1 else ""
    logp: list[np.ndarray | str] = []
    for begin in begins:
        own = langs[begin : begin + BLOCK_LANGUAGES]
        weight = np.full((buckets, len(own)), SMOOTHING)
        grams = rows.where(F.col("bucket").between(0, buckets) & F.col("lang").between(own[0], own[-1])).toPandas()
        weight[grams["bucket"], grams["lang"].map({x: k for k, x in enumerate(own)})] += grams["n"]
        block = np.log(weight / weight.sum(axis=0))
        logp.append(_saved(f"{folder}/{len(logp)}.npy", block) if folder else block)
    return {"langs": langs, "prior": np.log(np.maximum(priors, 1) / max(1, priors.sum())), "logp": logp, "buckets": buckets}


def _saved(address: str, block: np.ndarray) -> str:
    raw = io.BytesIO()
    np.save(raw, block)
    store, path = fs.FileSystem.from_uri(address)
    store.create_dir(path.rsplit("/", 1)[0])
    with store.open_output_stream(path) as out:
        out.write(raw.getvalue())
    return address


@functools.lru_cache(maxsize=1)
def _loaded(address: str) -> np.ndarray:
    store, path = fs.FileSystem.from_uri(address)
    with store.open_input_stream(path) as file:
        return np.load(io.BytesIO(file.read()))


def sparse_rows(values: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' n-gram counts as compressed sparse rows: where each text begins (and the end), buckets, counts.

    Null texts and texts without a letter have empty rows.
    """
    sizes, at, n = [0], [], []
    for value in values:
        total = None
        if value is not None and has_letter(value):
            for run in bucket_runs(value, buckets):
                part = np.bincount(run, minlength=buckets)
                total = part if total is None else total + part
        own = np.flatnonzero(total) if total is not None else np.zeros(0, dtype=np.int64)
        sizes.append(len(own))
        at.append(own)
        n.append(total[own] if total is not None else own)
    return np.cumsum(sizes), np.concatenate([np.zeros(0, dtype=np.int64), *at]), np.concatenate([np.zeros(0, dtype=np.int64), *n])


def log_likelihoods(rows: tuple[np.ndarray, np.ndarray, np.ndarray], prior: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Sparse block times log-probability matrix, plus log-priors: documents x languages."""
    begin, at, n = rows
    out = np.tile(prior, (len(begin) - 1, 1))
    first, most = 0, BLOCK // len(prior)
    while first < len(begin) - 1:
        # as many whole rows as fit in a block; a row has at most as many entries as there are buckets
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + most, side="right")) - 1)
        part = slice(begin[first], begin[last])
        if begin[last] > begin[first]:
            full = np.flatnonzero(np.diff(begin[first : last + 1]))
            out[first + full] += np.add.reduceat(n[part, None] * logp[at[part]], begin[first + full] - begin[first], axis=0)
        first = last
    return out


def predict_texts(values: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """The languages of whole texts and their posterior probabilities."""
    if not model["langs"]:
        return ["und"] * len(values), [0.0] * len(values)
    rows = sparse_rows(values, model["buckets"])
    empty, best, top, mass = np.diff(rows[0]) == 0, np.zeros(len(values), dtype=np.int64), np.full(len(values), -np.inf), np.zeros(len(values))
    begin = 0
    for block in model["logp"]:
        logp = _loaded(block) if isinstance(block, str) else block
        total = log_likelihoods(rows, model["prior"][begin : begin + logp.shape[1]], logp)
        # of equal languages the first one stays
        high = total.max(axis=1)
        best = np.where(high > top, begin + total.argmax(axis=1), best)
        high = np.maximum(high, top)
        mass = mass * np.exp(top - high) + np.exp(np.minimum(total - high[:, None], 0.0)).sum(axis=1)
        top, begin = high, begin + logp.shape[1]
    score = np.minimum(1.0, 1.0 / mass)
    return ["und" if e else model["langs"][k] for e, k in zip(empty.tolist(), best.tolist(), strict=True)], np.where(empty, 0.0, score).tolist()


def predict(docs: DataFrame, model: dict, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(dict.fromkeys(keep))
    inner = docs.select(*kept, F.col(text).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = predict_texts(texts_of(batch), shared.value)
            yield with_new(batch, tuple(kept), {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return inner.mapInArrow(score, f"{fields(docs, *kept)}, lang_pred string, score double")


def fold() -> object:
    """crc32 of the id as text, modulo 5: 0 is held out; a null id is neither held out nor learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the other folds."""
    model = fit(docs, train=F.coalesce(fold() != 0, F.lit(False)))
    return predict(docs, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known: neither ``und`` nor predicted with a score under ``least``."""
    model = fit(docs, train=F.coalesce(fold() != 0, F.lit(False)))
    rows, names = numbered(docs)
    found = predict(rows, model, text=names["text"], keep=tuple(rows.columns))
    return restored(found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)), names)
