"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector, derived from its code point by hashing, so that no alphabet is fixed. A
trigram's vector binds (multiplies) its letters' vectors, each permuted (rotated) by its place; a text's vector bundles
(adds) those of all its trigrams; a language's prototype bundles those of its training texts. A text gets the language
whose prototype has the largest cosine with it.

Texts are folded to lower case; every run of other characters counts as one space, and each word is set between spaces.
Counts and bundles are integers, so a prototype does not depend on the order of its parts.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512
#: Training rows for each language: about so many, drawn by a hash of doc_id, or all if there are fewer.
TRAIN_ROWS = 1500
FOLDS = 5
#: Characters that are read at a time, and different trigrams whose vectors are made at a time.
_CHUNK, _GRAMS = 500_000, 16_384
_SPACE = 32


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Random +-1 rows for code points; the same code point gets the same row everywhere."""
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over a list of texts: text numbers and trigram numbers with their counts, and the trigrams as rows of code points.

    Every letter is the middle of one trigram; a neighbour that is no letter, or is missing, counts as a space.
    """
    return _trigrams("\0".join(texts), 0)


def _trigrams(joined: str, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of texts joined by zeros; ``edge`` characters at either end are neighbours alone."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    text_of = np.cumsum(points == 0)
    kinds, code = np.unique(points, return_inverse=True)
    is_letter = np.array([chr(k).isalpha() for k in kinds], dtype=bool)
    letters = np.concatenate([[_SPACE], kinds[is_letter]]).astype(np.int64)  # the space is number 0
    code = np.concatenate([[0], np.where(is_letter, np.cumsum(is_letter), 0)[code], [0]]).astype(np.int64)
    n = len(letters)
    middle = code[1:-1] > 0
    if edge:
        middle[:edge] = middle[len(middle) - edge :] = False
    gram = ((code[:-2] * n + code[1:-1]) * n + code[2:])[middle]
    used, g = np.unique(gram, return_inverse=True)
    pair, counts = np.unique(text_of[middle] * max(1, len(used)) + g, return_counts=True)
    doc, g = pair // max(1, len(used)), pair % max(1, len(used))
    points3 = np.stack([letters[used // (n * n)], letters[used // n % n], letters[used % n]], axis=1) if len(used) else np.zeros((0, 3), dtype=np.int64)
    return doc, g, counts, points3


def gram_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bind three letters, the first rotated by two places, the second by one."""
    kinds, code = np.unique(points, return_inverse=True)
    code = code.reshape(points.shape)
    base = letter_vectors(kinds, dim)
    return np.roll(base, 2, axis=1)[code[:, 0]] * np.roll(base, 1, axis=1)[code[:, 1]] * base[code[:, 2]]


def bundles(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A row for each text: the sum of its trigrams' vectors; zeros if it has no letter. Longer texts are read in parts,
    each with its neighbours' edges, so that memory is bounded for any text."""
    if sum(map(len, texts)) <= _CHUNK:
        return _bundles("\0".join(texts), len(texts), 0, dim)
    out = np.zeros((len(texts), dim), dtype=np.float64)
    for i, text in enumerate(texts):
        padded = f" {text} "
        for at in range(0, len(text), _CHUNK):
            out[i] += _bundles(padded[at : at + _CHUNK + 2], 1, 1, dim)[0]
    return out


def _bundles(joined: str, texts: int, edge: int, dim: int) -> np.ndarray:
    out = np.zeros((texts, dim), dtype=np.float64)
    doc, gram, counts, points = _trigrams(joined, edge)
    for low in range(0, len(points), _GRAMS):
        vectors = gram_vectors(points[low : low + _GRAMS], dim).astype(np.float32)
        here = (gram >= low) & (gram < low + _GRAMS) if len(points) > _GRAMS else slice(None)
        own, g, n = doc[here], gram[here] - low, counts[here].astype(np.float32)
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, dtype=np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[own[a]] += n[a:b] @ vectors[g[a:b]]
    return out


def chunks(texts: Iterable[str | None]) -> Iterable[list[str]]:
    """Lists of lower-case texts of bounded length in all (one text at least)."""
    held, size = [], 0
    for text in texts:
        text = (text or "").replace("\0", " ").lower()
        if held and size + len(text) > _CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that training never sees: crc32 of the id's text, modulo folds, is 0. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def train(docs: DataFrame, dim: int = DIM, rows: int = TRAIN_ROWS) -> list[tuple[str, np.ndarray]]:
    """Prototypes by language, in order of the languages' names, from rows that are not held out and have a lang and a text.

    Of a language with more training rows, about ``rows`` are taken: those whose id's hash lies in a fraction of its range
    that the language's count decides. What reaches the driver is one vector for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # as many rows as there are languages; a literal map, so that texts are filtered where they are read
    share = {r["lang"]: rows / r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))
    taken = known.where(place < F.try_element_at(limit, F.col("lang"))).select("lang", "text")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for texts in chunks(part["text"]):
                    sums[lang] = sums.get(lang, 0) + bundles(texts, dim).sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "bundle": [v.astype(np.int64) for v in sums.values()]})

    parts = taken.mapInPandas(bundle, "lang string, bundle array<long>")
    summed = parts.groupBy("lang").agg(F.array(*(F.sum(F.col("bundle")[i]) for i in range(dim))).alias("bundle"))
    return sorted((r["lang"], np.array(r["bundle"], dtype=np.float64)) for r in summed.collect())


def predict(texts: list[str], languages: list[str], prototypes: np.ndarray, dim: int = DIM) -> list[tuple[str, float]]:
    """Language and cosine (0 where it is negative); und and 0 for a text without a letter."""
    vectors = bundles(texts, dim)
    norms = np.linalg.norm(vectors, axis=1)
    some = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
    if not len(languages):
        return [("und", 0.0)] * len(texts)
    cosines = (vectors @ prototypes.T) / np.where(norms > 0, norms, 1)[:, None]
    best = cosines.argmax(axis=1)
    return [(languages[b], float(min(1.0, max(0.0, c[b])))) if ok else ("und", 0.0) for b, c, ok in zip(best, cosines, some, strict=True)]


def identify(docs: DataFrame, text: str = "text", model: list[tuple[str, np.ndarray]] | None = None, dim: int = DIM) -> DataFrame:
    """docs with the columns lang_pred and score added, in place of any of these names, by the given model or one trained on
    docs.

    und is said of null texts and texts without a letter, and of all if there is nothing to learn from. Rows are mapped
    one by one: repeated rows are predicted alike, further columns pass through, ties go to the first language by name.
    """
    model = train(docs, dim) if model is None else model
    languages = [lang for lang, _ in model]
    prototypes = np.array([v / max(np.linalg.norm(v), 1e-12) for _, v in model]).reshape(len(model), dim)

    @F.pandas_udf("lang_pred string, score double")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[str, float]] = []
            for part in chunks(batch):
                found += predict(part, languages, prototypes, dim)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # a filter on a column of a deterministic one would be pushed below it, with a second run of it over all rows
    said = said.asNondeterministic()
    return docs.withColumn("_said", said(F.col(text))).select(*kept, F.col("_said.lang_pred").alias("lang_pred"), F.col("_said.score").alias("score"))
