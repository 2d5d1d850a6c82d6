import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, h string, block string, core int, hits string, item_id string, score string, quality_score__ string"


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, shared passages."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(40)]
    texts = {i: " ".join(word() for _ in range(r.randint(3, 60))) for i in range(12)}
    texts[12] = "It's a line of Shared text\n" + texts[3] + "\n  IT'S a line of shared TEXT \nshort\nshort\n"
    texts[13] = "it's a line of shared text"
    texts[14] = " ".join([word(), *passage, word()])
    texts[15] = " ".join([word(), word(), *passage])
    texts[16] = " ".join(passage + passage)
    texts[17] = " ".join(word() for _ in range(9000)) + "\n" * 50
    texts[18] = "x" * 20000
    texts[19] = "日本語 テスト <|endoftext|> \n\n 12 34\x0b½  🎉\r\n tail \x85 "
    texts[20] = texts[1] + " "
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    rows += [(30, None, None, None, None), (31, "", "en", None, 0), (32, " \n\t ", None, "s", 4), (None, texts[2], None, None, None),
             (None, texts[2], None, None, None), (None, None, None, None, None), (5, texts[5], "en", "s", 1), (5, texts[5], "en", "s", 1), (33, texts[5], "en", "s", 1), (6, texts[7], "en", "s", 1)]
    return [(*x, None, "h", "b", 1, None, "7", "x", None) for x in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
