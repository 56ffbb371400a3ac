import pytest
from conftest import contact_table

from msgloom.errors import SourceNotFound
from msgloom.operators.contacts import conflicts, first_per_key, resolve
from msgloom.schemas import ADDRESS_BOOK
from msgloom.sources.contacts import address_book_entries, read_contacts


def pairs(df):
    return dict(df.select("contact_key", "name").collect())


@pytest.fixture(scope="module")
def entries(spark):
    book = spark.createDataFrame(
        [
            (1, "Ann", "Lee", ["+1 (415) 1", "22"], ["Ann@X.org"]),
            (2, None, "Solo", ["+14151"], None),
            (3, " ", None, ["333"], ["nobody@x.org"]),
            (4, " Zoë", "", None, ["ann@x.org", "zoe@x.org"]),
            (5, "Ann", "Lee", ["22"], []),
        ],
        ADDRESS_BOOK,
    )
    return address_book_entries(book)


def test_address_book_is_flattened_in_order(entries):
    rows = entries.orderBy("ord").collect()
    assert [(r["contact_key"], r["name"]) for r in rows] == [
        ("+14151", "Ann Lee"), ("22", "Ann Lee"), ("ann@x.org", "Ann Lee"), ("+14151", "Solo"),
        ("ann@x.org", "Zoë"), ("zoe@x.org", "Zoë"), ("22", "Ann Lee"),
    ]


def test_first_name_wins_and_conflicts_are_reported(entries):
    assert pairs(first_per_key(entries)) == {
        "+14151": "Ann Lee", "22": "Ann Lee", "ann@x.org": "Ann Lee", "zoe@x.org": "Zoë",
    }
    reported = {r["contact_key"]: (r["kept"], r["names"]) for r in conflicts(entries).collect()}
    assert reported == {"+14151": ("Ann Lee", 2), "ann@x.org": ("Ann Lee", 2)}


def test_overrides_win(spark, entries):
    merged = resolve(first_per_key(entries), contact_table(spark, [("22", "Mum"), ("new", "New")]))
    assert pairs(merged)["22"] == "Mum" and pairs(merged)["new"] == "New" and pairs(merged)["+14151"] == "Ann Lee"


def test_override_files(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('contact_key,name\n+1415,"Lee, Ann"\nAnn@x.org,Ann\n')
    assert pairs(read_contacts(spark, str(good))) == {"+1415": "Lee, Ann", "Ann@x.org": "Ann"}
    lines = tmp_path / "good.json"
    lines.write_text('{"contact_key":"k","name":"n"}\n')
    assert pairs(read_contacts(spark, str(lines), "json")) == {"k": "n"}
    with pytest.raises(SourceNotFound):
        read_contacts(spark, str(tmp_path / "missing.csv"))


@pytest.mark.parametrize("fmt, text", [
    ("csv", "contact_key,name\n,Nobody\n"), ("json", '{"contact_key": {]\n'), ("csv", "contact_key,name\nk,\n"),
    ("csv", "contact_key,name\nk,Ann\nk,Bob\n"),
])
def test_bad_override_files_are_errors(spark, tmp_path, fmt, text):
    path = tmp_path / f"bad.{fmt}"
    path.write_text(text)
    with pytest.raises(Exception, match="NULL contact_key|NULL name|2 times|MALFORMED_RECORD"):
        read_contacts(spark, str(path), fmt).collect()
