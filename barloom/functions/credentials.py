"""Recognize credential-like keys in request maps and JSON documents."""

from __future__ import annotations

import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a key as a credential.
CREDENTIAL_TOKENS = (
    "auth", "authentication", "authorization", "bearer", "cookie", "cookies", "credential",
    "credentials", "password", "passwd", "secret", "signature", "token",
)
# Keys written without separators.
COMPACT_KEYS = (
    "accesskey", "accesskeyid", "accesstoken", "appkey", "appsecret", "apikey", "authtoken",
    "clientsecret", "consumerkey", "encryptionkey", "functionskey", "privatekey", "refreshtoken",
    "secretaccesskey", "secretkey", "securitytoken", "sessiontoken", "signingkey",
    "subscriptionkey",
)
# Endings of keys written without separators.
COMPACT_SUFFIXES = (
    "authorization", "credential", "passwd", "password", "secret", "signature", "token",
)
# Words that make a key next to them a credential.
KEY_QUALIFIERS = (
    "access", "api", "apim", "app", "aws", "azure", "consumer", "encryption", "functions",
    "oauth", "oauth2", "private", "secret", "service", "signing", "subscription",
)


def decode_keys(keys: Column) -> Column:
    """Undo percent escapes and compatibility characters until nothing changes."""

    decode = _decoder()

    def decode_batch(batch: pd.Series) -> pd.Series:
        return batch.map(decode, na_action="ignore")

    return F.pandas_udf(decode_batch, T.StringType())(keys)


def decode_key_lists(lists: Column) -> Column:
    """``decode_keys`` for an array of keys in each row."""
    decode = _decoder()

    def decode_batch(batch: pd.Series) -> pd.Series:
        return batch.map(lambda keys: [decode(key) for key in keys], na_action="ignore")

    return F.pandas_udf(decode_batch, T.ArrayType(T.StringType()))(lists)


def _decoder():
    # Nested, so that workers need no copy of this package.
    def decode(key: str) -> str:
        while (plain := unquote(unicodedata.normalize("NFKC", key))) != key:
            key = plain
        return key

    return decode


def key_tokens(decoded: Column) -> Column:
    """Lower-case words of a key: camelCase and ACRONYMWords split, trailing digits dropped."""
    words = F.regexp_replace(decoded, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.regexp_replace(words, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.lower(F.regexp_replace(words, "[ßẞ]", "ss"))
    stripped = F.transform(
        F.split(words, "[^A-Za-z0-9]+"), lambda w: F.regexp_replace(w, r"\d+$", "")
    )
    return F.filter(stripped, lambda w: w != "")


def is_credential(tokens: Column) -> Column:
    def any_of(names):
        return F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names]))

    suffix = "(" + "|".join(COMPACT_KEYS + COMPACT_SUFFIXES) + ")$"
    bare_key = F.array_contains(tokens, "key") & ((F.size(tokens) == 1) | any_of(KEY_QUALIFIERS))
    return (
        any_of(CREDENTIAL_TOKENS)
        | any_of(COMPACT_KEYS)
        | F.array_join(tokens, "").rlike(suffix)
        | bare_key
    )


def classify_keys(keys: DataFrame) -> DataFrame:
    """Distinct values of ``key`` with the verdict.

    Keys repeat endlessly, so they are reduced to distinct values (combined before the
    shuffle) before Python sees any of them.
    """
    return (
        keys.select("key")
        .distinct()
        .withColumn("is_credential", is_credential(key_tokens(decode_keys(F.col("key")))))
    )


def names_credential(keys: Column) -> Column:
    """Whether an array of keys names a credential, decided inside the row; false for NULL.

    Few keys reach Python: only those that hold a percent sign or a character beyond ASCII can
    change when they are decoded.
    """
    known = F.filter(keys, lambda k: k.isNotNull())
    odd = F.filter(known, lambda k: k.rlike(r"[%\x{80}-\x{10FFFF}]"))
    judged = F.concat(known, decode_key_lists(odd))
    return F.coalesce(F.exists(F.transform(judged, key_tokens), is_credential), F.lit(False))


def json_keys(df: DataFrame, id_column: str, json_column: str, *, depth: int) -> DataFrame:
    """All object keys of a JSON text column, one row each, with their level."""
    walked = with_json_keys(df.select(id_column, json_column), json_column, "_keys", depth=depth)
    return walked.select(id_column, F.inline("_keys"))


def with_json_keys(df: DataFrame, json_column: str, name: str, *, depth: int) -> DataFrame:
    """``df`` with the distinct object keys of a JSON text and their levels as array ``name``.

    Each document is walked level by level inside its own row, so the table is read once. Keys
    below ``depth`` levels are found as string tokens before a colon, however deep they are,
    and carry the level ``depth + 1``.
    """
    walked = df.withColumn("_level_1", _members(F.col(json_column)))
    for level in range(2, depth + 2):
        inner = F.filter(f"_level_{level - 1}", lambda m: m["value"].rlike(r"^\s*[\[{]"))
        walked = walked.withColumn(
            f"_level_{level}", F.flatten(F.transform(inner, lambda m: _members(m["value"])))
        )
    found = [
        F.transform(F.filter(f"_level_{level}", lambda m: m["key"].isNotNull()), _at_level(level))
        for level in range(1, depth + 2)
    ]
    below = F.transform(
        F.flatten(F.transform(f"_level_{depth + 1}", lambda m: key_tokens_in(m["value"]))),
        lambda key: F.struct(key.alias("key"), F.lit(depth + 1).alias("level")),
    )
    levels = [f"_level_{level}" for level in range(1, depth + 2)]
    return walked.withColumn(name, F.array_distinct(F.concat(*found, below))).drop(*levels)


def key_tokens_in(text: Column) -> Column:
    """Keys anywhere in a JSON text: strings that a colon follows. Empty for NULL."""
    strings = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(r'"(?:[^"\\]|\\.)*+"\s*+:?'), F.lit(0)
    )
    keys = F.filter(strings, lambda s: s.endswith(":"))
    quoted = F.transform(keys, lambda s: F.regexp_replace(s, r"\s*:$", ""))
    plain = F.transform(
        quoted,
        # An escape that does not parse leaves the key as it is written.
        lambda s: F.coalesce(
            F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0)),
            F.substring(s, F.lit(2), F.length(s) - 2),
        ),
    )
    return plain


def is_readable(text: Column) -> Column:
    """One JSON object, array or scalar with nothing before or after it, or NULL."""
    scalar = r'^\s*("(?:[^"\\]|\\.)*+"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)?\s*$'
    closed = text.rlike(r"^\s*\{[\s\S]*\}\s*$") | text.rlike(r"^\s*\[[\s\S]*\]\s*$")
    # Brackets inside strings do not count; more than one top-level value leaves a remainder.
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    parsed = F.from_json(text, "map<string,string>").isNotNull() | F.from_json(text, "array<string>").isNotNull()
    single = ~bare.rlike(r"[}\]]\s*[{\[\w]")
    return F.coalesce(text.rlike(scalar) | (closed & parsed & single), F.lit(True))


def _at_level(level: int):
    return lambda member: F.struct(member["key"].alias("key"), F.lit(level).alias("level"))


def _members(text: Column) -> Column:
    """Members of a JSON object, or items of an array without a key; empty for scalars."""
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    items = F.transform(
        F.from_json(text, "array<string>"),
        lambda item: F.struct(F.lit(None).cast("string").alias("key"), item.alias("value")),
    )
    empty = F.array().cast("array<struct<key:string,value:string>>")
    kind = "array<struct<key:string,value:string>>"
    return F.when(text.rlike(r"^\s*\{"), F.coalesce(pairs.cast(kind), empty)).otherwise(
        F.when(text.rlike(r"^\s*\["), F.coalesce(items.cast(kind), empty)).otherwise(empty)
    )


def screen_json(df: DataFrame, id_column: str, json_column: str, *, depth: int = 6) -> DataFrame:
    """Rows to quarantine: those with a credential key at any depth, and those that are no readable JSON.

    Unreadable text has one row with the key ``<unreadable>`` at level 0: what cannot be
    screened does not pass. ``depth`` only bounds how far levels are told apart.
    """
    keys = json_keys(df, id_column, json_column, depth=depth)
    judged = keys.join(classify_keys(keys), "key").filter("is_credential")
    unreadable = df.filter(~is_readable(F.col(json_column))).select(
        id_column, F.lit("<unreadable>").alias("key"), F.lit(0).alias("level")
    )
    return judged.select(id_column, "key", "level").unionByName(unreadable)
