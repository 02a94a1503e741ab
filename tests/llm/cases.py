"""Documents with nulls, empty and long texts, ties, repeated rows and extra columns."""

import os
import random

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score int, slot int, kept string, fingerprint string, path string, h int, n int"


def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéñß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = text(90), text(12_000)
    out = [(i, text(rng.randint(1, 200)), rng.choice(["en", "de"]), rng.choice("ab")) for i in range(0, 60, 2)]
    out += [(101, text(30) + " " + passage + " " + text(20), "en", "a"), (103, passage + "\n" + text(40), "en", "b"), (105, text(5) + "\n\n" + passage, None, None)]
    out += [(201, long, "en", "a"), (203, long.replace(" ", "  ", 50) + " end", "de", "a"), (205, "x" * 5000, "en", "b"), (207, "In. " * 400, "en", "b")]
    out += [(301, None, "en", "a"), (303, "", "en", "a"), (305, " \t\n ", None, "b"), (307, "!!! 123", "de", None), (309, "ß", "de", None), (311, "two words", "en", "a"), (313, "日本語のテキスト" * 60, "ja", "c")]
    out += [(None, text(50), "en", "a"), (None, None, None, None)]
    out += [out[0], out[0], (401, out[0][1], "de", "b"), (403, out[2][1].upper(), "en", "b"), (-5, text(40), "en", "a"), ((1 << 60) + 1, text(40), "en", "a")]
    return out


def edge(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, 2, "x", "f", "p", 3, 4) for r in rows()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
