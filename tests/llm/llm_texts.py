import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """Texts as documents 0, 1, ...; a text may be a pair (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], SCHEMA)


def clashing(df):
    """The same rows with columns that have the names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(f"own {name}") for name in (
        "found", "_found", "spans", "features", "score", "kept", "items", "_hits", "ids", "numbers", "block", "bucket", "words", "sigs",
        "set_id", "node", "root", "_class", "_least", "k1", "k2", "gram", "seg", "runs", "later", "held_out", "lang_pred", "_l", "_s", "_t")})


ODD = [None, "", " \n\t \n", "a", "...", "ü", "one two three", "line\nline\n\nline", "\x00zero \x1f unit", "tab\tand\x0bvt\r\n", "日本語 テキスト 🙂 é",
       "word " * 40_000, "x" * 150_000, "don't we'll they've I'm 'tis it's ''s 'Re  double   triple\n\n\nlines \n x\t\ty ", " lead and trail ",
       "▁mark ▁▁ and <s> </s> <unk> <0x41>", "mid<|endoftext|>dle <|endoftext|>", " nbsp em 　wide\u0085nel", "１２３ ½ Ⅷ ²x 3rd"]


@pytest.fixture(scope="session")
def odd():
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "é", "ß", "1", "٣", "!", "...", "🙂", "\t", " ", "▁", "\x00", "中", "́", "Ω", "ǅ"]
    noise = ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(150)]
    return ODD + noise
