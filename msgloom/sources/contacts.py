"""Reading contact names: an override table, and an address book."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.errors import SourceNotFound
from msgloom.functions.keys import email_key, phone_key
from msgloom.functions.text import trim_unicode
from msgloom.schemas import CONTACTS
from msgloom.session import is_missing_path


def read_contacts(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Override table of contact key and name, set by hand. Malformed rows, NULL keys or names
    and repeated keys are errors."""
    defaults = {"mode": "FAILFAST", "header": "true"} if fmt in ("csv", "json") else {}
    try:
        table = spark.read.schema(CONTACTS).format(fmt).options(**{**defaults, **options}).load(path)
    except AnalysisException as error:
        if is_missing_path(error):
            raise SourceNotFound(f"no contact table at {path}") from error
        raise
    checked = table.withColumns({
        name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"contact table has a NULL {name}"))).otherwise(F.col(name))
        for name in ("contact_key", "name")
    })
    # At most one row.
    twice = checked.groupBy("contact_key").agg(F.count("name").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"contact key {twice['contact_key']} stands {twice['n']} times")
    return checked


def address_book_entries(book: DataFrame) -> DataFrame:
    """Flatten an address book to one row per phone and e-mail: key, name, order.

    Contacts without a name are left out. `ord` follows the contact id, then
    phones before e-mails, then the place in the list.
    """
    name = trim_unicode("concat(coalesce(given_name, ''), ' ', coalesce(family_name, ''))")
    none = "CAST(array() AS ARRAY<STRING>)"
    keys = f"""concat(transform(coalesce(phones, {none}), x -> {phone_key('x')}),
        transform(coalesce(emails, {none}), x -> {email_key('x')}))"""
    named = book.selectExpr("contact_id", f"{name} AS name", f"{keys} AS keys").where("name <> ''")
    placed = named.selectExpr("name", "contact_id", "posexplode(keys) AS (place, contact_key)")
    return placed.selectExpr("contact_key", "name", "struct(contact_id, place) AS ord")
