import random

import pytest

#: doc_id, text, lang, source, n_chars and columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, n int, score string, size int, at int, key int"


def prose(rnd, n, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def vocabularies():
    rnd = random.Random(5)
    parts = {"en": "th er on an re he in ed nd ha", "de": "ei sch ung ich ge ber zu ver", "fr": "é eau que ou tion è le ai"}
    return {lang: ["".join(rnd.choice(p.split()) for _ in range(rnd.randint(1, 4))) for _ in range(400)] for lang, p in parts.items()}


@pytest.fixture(scope="session")
def rows(vocabularies):
    """Texts with copies, near copies, shared passages and lines, nulls, empty, blank and long texts."""
    rnd = random.Random(11)
    passage = prose(rnd, 70, vocabularies["en"])
    line = "Alle Rechte vorbehalten, see terms."
    out = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        out.append([prose(rnd, rnd.randint(3, 260), vocabularies[lang]), lang, f"s{i % 14}" if i % 3 else "hot"])
    for i in range(0, 40, 4):
        out[i][0] = "\n".join([out[i][0], line if i % 8 else f"  {line}\t", prose(rnd, 30, vocabularies["en"])])
        out[i + 1][0] += "\n" + line
    for i in (12, 33, 57, 80):
        out[i][0] = out[i][0] + " " + passage + "\n" + out[i][0][:40]
    for i in (20, 40, 60, 61):
        out[i] = list(out[19])
    longest = prose(rnd, 20000, vocabularies["de"])
    out.append([longest, "de", "hot"])
    for changed in (1, 6, 12, 12, 25):
        near = longest.split()
        for at in rnd.sample(range(len(near)), changed):
            near[at] = "changed"
        out.append([" ".join(near), "de", "hot"])
    out += [["word " * 300, "en", "hot"], ["ab cd " * 150, "en", "s1"],
            ["word " * 180, None, None], ["", "en", "s1"], [" \t\n ", "fr", None], [None, "de", "s2"], [None, None, None],
            ["123 456 !!", "en", "s3"], ["x", None, "s4"], ["a\x00b  c d <s></s>▁é  \n\n  z ", "en", "s5"]]
    made = [(i, t, lang, s, None if t is None else len(t)) for i, (t, lang, s) in enumerate(out)]
    made += [made[3], made[3], (5, "another text of the same id", "en", "s1", 3), (None, out[19][0], "en", "hot", 1), (None, None, None, None, None)]
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, "y", 2, 3, 4) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
