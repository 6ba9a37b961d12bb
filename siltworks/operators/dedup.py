"""Near-duplicate removal within each language: shingles, seeded MinHash signatures, bands, components, one survivor each."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.components import components
from siltworks.operators.semijoin import marked
from siltworks.storage import settle, spread

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class MinhashConfig:
    n_grams: int = 5
    num_buckets: int = 14
    hashes_per_bucket: int = 8
    seed: int = 1

    @classmethod
    def of(cls, given: dict) -> MinhashConfig:
        """From a configuration; unknown names are refused."""
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    @classmethod
    def read(cls, path: str) -> MinhashConfig:
        """From a JSON file."""
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    def coefficients(self) -> list[tuple[int, int]]:
        r = random.Random(self.seed)
        return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(self.num_buckets * self.hashes_per_bucket)]


def signatures(docs: DataFrame, c: MinhashConfig = MinhashConfig(), words: Callable[[str], list[str]] = str.split) -> DataFrame:
    """(doc_id, lang, signature array<long>) of docs(doc_id, lang, text); texts of fewer than c.n_grams words have none. A shingle's
    hash is the first 28 bits of its md5; each of the seeded functions is affine modulo 2**31 - 1. `words` cuts a text into words,
    which must not hold a blank."""
    ab, n = c.coefficients(), c.n_grams

    def run(it):
        mul, add = (np.array(x, dtype=np.uint64)[:, None] for x in zip(*ab))
        md5 = hashlib.md5
        for b in it:
            out, has = [], []
            for t in b.column("text").to_pylist():
                w = words(t)
                has.append(len(w) >= n)
                if not has[-1]:
                    continue
                # shingles are slices of the text with single blanks, from where a word begins to where the n-th ends
                line = " ".join(w).encode("utf-8", "replace")
                blank = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
                start, end = [0, *(blank + 1).tolist()], [*blank.tolist(), len(line)]
                z = np.frombuffer(b"".join([md5(line[i:j]).digest()[:4] for i, j in zip(start, end[n - 1 :])]), dtype=">u4")
                z = np.unique(z).astype(np.uint64) >> np.uint64(4)
                x = mul * z + add
                x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))  # modulo 2**31 - 1, but for one multiple
                out.append(np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x).min(axis=1).astype(np.int64))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(ab)), flat)
            b = b.filter(pa.array(has, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), sig], names=["doc_id", "lang", "signature"])

    texts = docs.where("text IS NOT NULL").select("doc_id", "lang", "text")
    return spread(texts).mapInArrow(run, "doc_id long, lang string, signature array<long>")


def band_keys(sig: DataFrame, c: MinhashConfig = MinhashConfig()) -> DataFrame:
    """(doc_id, lang, h): the bands of each signature."""
    n = c.hashes_per_bucket
    bands = F.transform(F.sequence(F.lit(0), F.lit(c.num_buckets - 1)), lambda i: F.xxhash64(i, F.array_join(F.slice("signature", i * n + 1, n).cast("array<string>"), ",")))
    return sig.select("doc_id", "lang", F.explode(bands).alias("h"))


def duplicate_links(sig: DataFrame, c: MinhashConfig = MinhashConfig()) -> DataFrame:
    """(a, b): each record with the least id that has an equal band, within a language (null being one too). Links of a band form a
    star, so that a band shared by n records gives n - 1 links, and the star's centre comes from map-side minima."""
    rows = band_keys(sig, c)
    least = rows.groupBy("lang", "h").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("lang").alias("l"), F.col("h").alias("k"), "a")
    return rows.join(least, (F.col("h") == F.col("k")) & F.col("lang").eqNullSafe(F.col("l"))).where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()


def clusters(docs: DataFrame, c: MinhashConfig = MinhashConfig()) -> DataFrame:
    """(doc_id, root) of the records that have duplicates; root is the one that survives."""
    return components(duplicate_links(settle(signatures(docs, c)), c)).withColumnRenamed("id", "doc_id")


def split_duplicates(docs: DataFrame, c: MinhashConfig = MinhashConfig()) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed) of docs: of each cluster the record of the least doc_id survives; records without signature always do."""
    gone = settle(clusters(docs, c).where("doc_id <> root").select("doc_id"))
    near = marked(docs, "doc_id", gone, "_maybe")
    # few texts can be among those removed, only these are shuffled
    maybe = near.where("_maybe").drop("_maybe")
    return near.where("NOT _maybe").drop("_maybe").unionByName(maybe.join(gone, "doc_id", "left_anti")), maybe.join(gone, "doc_id", "left_semi")


__all__ = ["MinhashConfig", "band_keys", "clusters", "duplicate_links", "signatures", "split_duplicates"]
