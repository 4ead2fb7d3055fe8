"""Contacts: equal phones, equal names, missing parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(phone: Column) -> Column:
    """Decimal digits of any script. Phones without any are all the same."""
    return F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^\p{Nd}]", "")


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _shared(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows whose key another row has. The count comes back by a join, so no key is one task's work."""
    keyed = rows.withColumn("key", key)
    many = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(many, "key").select(F.lit(name).alias("category"), "key", "id", "name", "phone", "members")


def duplicate_phones(contacts: DataFrame) -> DataFrame:
    return _shared(contacts.where(~blank(F.col("phone"))), digits(F.col("phone")), "DUPLICATE_PHONE")


def same_names(contacts: DataFrame) -> DataFrame:
    return _shared(contacts.where(~blank(F.col("name"))), F.lower(F.trim("name")), "SAME_NAME")


def incomplete(contacts: DataFrame) -> DataFrame:
    return contacts.where(blank(F.col("name")) | blank(F.col("phone")))


def summary(contacts: DataFrame) -> DataFrame:
    """Three rows; a contact may count in several."""
    parts = [(0, "DUPLICATE_PHONE", duplicate_phones(contacts)), (1, "SAME_NAME", same_names(contacts)), (2, "INCOMPLETE", incomplete(contacts))]
    rows = [df.agg(F.count("*").alias("items")).select(F.lit(i).alias("position"), F.lit(name).alias("category"), "items") for i, name, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
