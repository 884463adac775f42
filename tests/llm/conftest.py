import random

import pytest

#: Columns that operators use inside, to see that clashing names do no harm.
CLASHES = ("version", "pos", "line", "lines", "key", "k1", "k2", "dropped", "kept", "holder", "fp", "rep", "component_id", "score", "lang_pred", "piece", "start", "length", "bucket", "number", "core", "context", "runs", "windows", "doc", "x", "rank", "item_id")
WORDS = ["the", "of", "stone", "river", "Über", "naïve", "quick", "Data", "model", "token", "école", "straße", "and", "to", "x1", "42"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus():
    """(doc_id, text, lang): copies, near copies, shared passages and lines, and every odd case."""
    rng = random.Random(5)
    passage, line = prose(rng, 120), "This line is shared by very many of the documents, all of it."
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(3, 300))
        if i % 5 == 0:
            text += "\n" + ("  " + line.upper() if i % 2 else line + "\t") + "\n" + prose(rng, 20)
        if i % 7 == 0:
            text = prose(rng, 30) + passage + prose(rng, 30)
        rows.append((i, text, "en" if i % 2 else "fr"))
    rows += [(60, rows[7][1], "en"), (61, rows[8][1].upper(), "en"), (62, rows[14][1].replace("stone", "rock", 1), None)]
    rows += [(63, None, "en"), (64, "", "fr"), (65, " \n\t\n", "en"), (66, "1234 !!! 5678", "en"), (67, "\n\n" + line, None)]
    rows += [(68, prose(rng, 20_000), "en"), (69, "word", "fr"), (70, "two words", "fr"), (71, "日本語 😀 é İstanbul ΣΑΣ <|endoftext|> don't we'll", "en")]
    rows += [(72, "ab" * 2000, "en"), (73, "ab" * 900, "en"), (74, rows[3][1], "en"), (74, rows[3][1], "en"), (None, rows[3][1], None), (None, "nobody's text", "en")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus, with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), *["clash"] * len(CLASHES)) for r in rows], schema).repartition(3).persist()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
