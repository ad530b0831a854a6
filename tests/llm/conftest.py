import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"

LONG = "lange wörter über ñandú " * 4000
#: Nulls, empty and long texts, ties, repeated rows, odd characters.
TEXTS = [
    None, "", " \t\n ", "one", "one two", "One  two", "one\ttwo", "a b c d e f g h i j k l", LONG, LONG + "end", "ok 漢字 😀 \x00 é ▁x", "12 34", "...", "one", "one two",
    "Released under the MIT License. Mail ann.b@x.org or +1 (183) 555-1276.",
]


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id null for one row, repeated for two, and columns whose names the operators use themselves."""
    own = ["k_id", "k_sha", "__id", "__sha", "__gone", "id", "sha", "row", "kept", "th", "hash", "h", "name", "level", "component_id", "d.e"]
    rows = [(None if k == 3 else 1 if k in (13,) else k, t, "en" if k % 2 else None, "src0", None, 7, "x", *(f"{c}{k}" for c in own)) for k, t in enumerate(TEXTS)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, fp string, " + ", ".join(f"`{c}` string" for c in own))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    """doc_id: text of the small table, read without Spark."""
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def benchmark_items():
    return duckdb.sql(f"SELECT CAST(item_id AS VARCHAR), coalesce(text, '') FROM '{FOLDER}/benchmark.parquet'").fetchall()
