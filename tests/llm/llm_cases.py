"""Small tables with the cases that every operator has to stand: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n int, part string, bucket int, start string, component string, tie long"
WORDS = {"en": "the of and ing tion er on that with this for are from have they house water".split(), "de": "der die das und nicht ein eine für über straße grün schön wasser haus ist mit".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "er"]) for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        out.append((k, prose(rng, lang, rng.randint(5, 90)), lang, f"s{k % 4}"))
    base = prose(rng, "en", 80).split()
    for k in range(60, 75):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"changed{k}"
        out.append((k, " ".join(copy), "en", "s0"))
    out += [(80, None, "en", "s1"), (81, "", None, None), (None, "text without an id, long enough to be five words", "en", "s2"), (82, "12345 67890 !!", None, "s3")]
    out += [(83, out[5][1], "en", "s0"), (84, out[5][1], "en", "s0"), (90, out[6][1], "de", "s2"), (90, out[6][1], "de", "s2"), (91, "one", "en", "s1"), (91, "two other words", "en", "s1")]
    out.append((95, prose(rng, "en", 30000), "en", "s1"))
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, None, "x", 3, None, "c", 7) for r in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
