"""Small documents with every awkward case, and brute-force helpers."""
import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # extra columns whose names clash with those of results
                     T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("size", T.IntegerType()), T.StructField("name", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = re.compile(r"[\x20\x09-\x0D]+")


def words(rng, n):
    return [rng.choice("abcdefgh") + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def rows():
    rng = random.Random(4)
    texts = [None, "", " ", "\n\t ", "one", "A a a A", "x y  z", "né \U0001F600 ñ", "the same three words " * 40]
    base = [words(rng, rng.choice([60, 90, 150, 400])) for _ in range(12)]
    for b in base:
        texts.append(" ".join(b))
        texts.append("  ".join(b) + "\n")  # equal after normalisation, but for the end
        for share in (0.02, 0.05, 0.1):
            c = list(b)
            for i in range(len(c)):
                if rng.random() < share:
                    c[i] = rng.choice(words(rng, 1))
            texts.append(" ".join(c))
    texts += [" ".join(base[0])] * 30 + [" ".join(words(rng, 9000))] * 2
    texts += ["la " * 3000, "word | " * 50, "Released under the MIT License. Under the MIT license, CC BY-NC 4.0",
              "Licensed under the Apache License, Version 2.0; GNU General Public License version 3"]
    rng.shuffle(texts)
    out = [(i, t, "en", rng.choice([None, "", "b", "a", "hot", "hot", "hot"]), len(t or ""), "k", "s", 1, "n") for i, t in enumerate(texts)]
    out += [(None, "no id at all", "en", "a", 1, "k", "s", 1, "n"), (None, None, None, None, None, None, None, None, None)]
    out += [out[15], out[15], out[20]]  # repeated rows
    return out


def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(v):
    return (v is not None, v if v is not None else 0)


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
