"""Steps that hide personal values."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import as_text, col, names_of, replace
from tidemill.operators.base import STEPS, StepContext
from tidemill.operators.rules import EMAIL

#: The digests that may be asked for.
ALGORITHMS = ("sha256", "sha384", "sha512", "sha3_256", "sha3_384", "sha3_512", "blake2b", "blake2s")


@STEPS.register("hash_columns", "pseudonymize")
def hash_columns(df: DataFrame, context: StepContext, columns, key: str | None = None, algorithm: str = "sha256", target_suffix: str = "", keep_original: bool = False) -> DataFrame:
    """Hex digests of values' texts, keyed (HMAC) or plain; null stays null.

    SHA-2 without a key is a built-in function; the key never becomes part of a plan.
    """
    if algorithm not in ALGORITHMS:
        raise ConfigurationError(f"algorithm is one of {', '.join(ALGORITHMS)}")

    @F.pandas_udf(T.StringType())
    def digest(texts: pd.Series) -> pd.Series:
        if key:
            return texts.map(lambda t: hmac.new(key.encode(), t.encode(), algorithm).hexdigest(), na_action="ignore")
        return texts.map(lambda t: hashlib.new(algorithm, t.encode()).hexdigest(), na_action="ignore")

    new = {}
    for name in names_of(columns):
        if name not in df.columns:
            continue
        text = as_text(col(name), df.schema[name].dataType)
        built_in = not key and algorithm in ("sha256", "sha384", "sha512")
        suffix = target_suffix or ("_hash" if keep_original else "")
        new[name + suffix] = F.sha2(text, int(algorithm[3:])) if built_in else digest(text)
    out = replace(df, new)
    gone = [c for c in names_of(columns) if c not in new and not keep_original]
    return out.select(*(col(c) for c in out.columns if c not in gone))


@STEPS.register("encrypt_columns", "encrypt")
def encrypt_columns(df: DataFrame, context: StepContext, columns, key: str) -> DataFrame:
    """Values under AES-GCM with a key derived from ``key`` and a salt of this run: ``v1:<salt>:<base64>``.

    The key is derived once on the driver with scrypt; a random nonce makes equal values differ.
    """
    salt = os.urandom(16)
    secret = hashlib.scrypt(key.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)
    head = f"v1:{base64.urlsafe_b64encode(salt).decode()}:"
    new = {}
    for name in names_of(columns):
        if name in df.columns:
            text = as_text(col(name), df.schema[name].dataType)
            new[name] = F.concat(F.lit(head), F.base64(F.aes_encrypt(text.cast("binary"), F.lit(secret), F.lit("GCM"))))
    return replace(df, new)


def decrypt(c, key: str, salt_text: str):
    """The plain text of a column that :func:`encrypt_columns` made, for one run's salt."""
    secret = hashlib.scrypt(key.encode(), salt=base64.urlsafe_b64decode(salt_text), n=2**14, r=8, p=1, dklen=32)
    return F.try_aes_decrypt(F.unbase64(F.element_at(F.split(c, ":"), 3)), F.lit(secret), F.lit("GCM")).cast("string")


def masked(c, keep_start: int, keep_end: int, mark: str):
    """All but some characters at the ends replaced; short values are hidden whole."""
    n = F.length(c)
    whole = (n <= keep_start + keep_end) | (n < 4)
    middle = F.repeat(F.lit(mark), (n - keep_start - keep_end).cast("int"))
    return F.when(whole, F.repeat(F.lit(mark), n)).otherwise(F.concat(F.substring(c, 1, keep_start), middle, F.right(c, F.lit(keep_end))))


def masked_email(c, mark: str):
    """The first letter, marks for the rest before the @, and the domain."""
    at = F.instr(c, "@")
    first, hidden = F.substring(c, F.lit(1), F.when(at > 1, 1).otherwise(0)), F.greatest(at - 2, F.lit(1))
    return F.concat(first, F.repeat(F.lit(mark), hidden.cast("int")), F.substring(c, at, F.length(c)))


@STEPS.register("mask_pii", "mask")
def mask_pii(df: DataFrame, context: StepContext, columns, strategy: str = "auto", keep_start: int = 0, keep_end: int = 4, mask_char: str = "*") -> DataFrame:
    """Values masked as e-mail, card, in part or in full; ``auto`` looks at each value."""
    new = {}
    for name in names_of(columns):
        if name not in df.columns:
            continue
        c = as_text(col(name), df.schema[name].dataType)
        digits = F.regexp_replace(c, r"\D", "")
        is_card = c.rlike(r"^\d(?:[ -]?\d){12,18}$") & F.call_function("luhn_check", digits)
        is_email = c.rlike(EMAIL)
        card = F.concat(F.repeat(F.lit(mask_char), (F.length(digits) - 4).cast("int")), F.right(digits, F.lit(4)))
        part = masked(c, keep_start, keep_end, mask_char)
        full = F.repeat(F.lit(mask_char), F.length(c))
        choices = {
            "auto": lambda: F.when(is_email, masked_email(c, mask_char)).when(is_card, card).otherwise(part),
            "partial": lambda: part,
            "email": lambda: F.when(c.contains("@"), masked_email(c, mask_char)).otherwise(full),
            "card": lambda: F.when(F.length(digits) > 4, card).otherwise(F.repeat(F.lit(mask_char), F.length(digits))),
            "full": lambda: full,
        }
        if strategy not in choices:
            raise ConfigurationError(f"strategy is one of {', '.join(choices)}")
        new[name] = choices[strategy]()
    return replace(df, new)
