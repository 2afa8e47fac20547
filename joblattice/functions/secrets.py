"""API keys: encrypted at rest, masked on display.

The AES key comes from the session setting ``spark.joblattice.secret.key``
(16, 24 or 32 characters). ``session.SETTINGS`` redacts it in plans.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from joblattice.config import SECRET_CONF


def secret_key(spark: SparkSession) -> Column:
    key = spark.conf.get(SECRET_CONF, None)
    if not key:
        raise ValueError(f"set {SECRET_CONF} before API keys are stored or read")
    return F.lit(key)


def encrypt(api_key: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce per row; null stays null."""
    return F.aes_encrypt(api_key.cast("binary"), key.cast("binary"))


def decrypt(stored: Column, key: Column) -> Column:
    return F.aes_decrypt(stored, key.cast("binary")).cast("string")


def masked(api_key: Column) -> Column:
    """Every letter, digit and other sign hidden."""
    return F.mask(api_key, F.lit("*"), F.lit("*"), F.lit("*"), F.lit("*"))
