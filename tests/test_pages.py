import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.shapes import FIELDS, scan_cells
from plumbline.operators import pages as P

TOKEN = "ghp_" + "a" * 24
PEM = "-----BEGIN EC PRIVATE KEY-----\nabc\n-----END EC PRIVATE KEY-----"
PIECES = [
    TOKEN, PEM, "me@corp.org", "postgres://u:p@db.internal/x", "https://user:pw@host.example.org", "1.2.3.4", "Bearer abc.def", "password = 'x y z'", 'api_key: "k=1; token=2"', "token=abc", "example: ", "\n",
    "payload: 'a'", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "-----BEGIN EC PRIVATE KEY-----", "-----END EC PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", " ", "é\U0001f600", "'", '"', "=", "user", "filler " * 5,
]


def whole(df):
    out = scan_cells(df, "id", "t", None).select("id", F.explode("matches").alias("m")).select("id", "m.*")
    return sorted(map(repr, (tuple(r) for r in out.select("id", *FIELDS).collect())))


def paged(df, core):
    return sorted(map(repr, (tuple(r) for r in P.scan_pages(df, "id", "t", core).select("id", *FIELDS).collect())))


@pytest.mark.parametrize("core", [7, 300])
def test_pages_give_what_one_reading_gives(spark, core):
    rnd = random.Random(core)
    texts = ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(14 if core > 7 else 5)]
    texts += [None, "", " ", "no candidate here", (TOKEN + " ") * 20]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "id long, t string, page int, family string")
    want = whole(df)
    assert want and paged(df, core) == want


def test_every_border_of_tokens_and_envelopes(spark):
    rows = []
    for k, piece in enumerate((TOKEN, PEM, "postgres://u:p@db.internal/x", "password = 'x y z'")):
        rows += [(1000 * k + shift, "." * shift + " " + piece + " tail me@corp.org") for shift in range(0, len(piece) + 3)]
    df = spark.createDataFrame(rows, "id long, t string")
    assert paged(df, 40) == whole(df)


def test_searches_that_depend_on_the_page_before(spark):
    """Quotes that pair otherwise when a search begins among them: pages are searched again from where the last one ended."""
    chain = "".join(f"a{i}='token=" for i in range(300))
    long = 'password="' + "token='q' " * 700 + '" secret="r"'
    df = spark.createDataFrame([(1, chain), (2, long), (3, "x" + chain), (4, "token='" + "a\\'" * 900 + "' pwd='b'")], "id long, t string")
    want = whole(df)
    assert paged(df, 50) == want and paged(df, 333) == want


def test_empty_table(spark):
    assert P.scan_pages(spark.createDataFrame([], "id string, t string"), "id", "t").count() == 0


def test_one_cell_is_many_tasks(spark):
    text = "some plain words and then me@corp.org\n" * 20_000
    df = spark.createDataFrame([("a", text)], "id string, t string")
    got = P.scan_pages(df, "id", "t", 10_000)
    assert got.count() == 20_000 and got.agg(F.max("end")).first()[0] == len(text) - 1
