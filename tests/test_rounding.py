"""Rounding of doubles as the SQL of the queries has it, to the bit."""

import struct

import duckdb
from pyspark.sql import functions as F

from docmill.functions.text import round_half_away


def test_bits_are_those_of_sql(spark):
    xs = [0.0, -2e-7, 2e-7, -4.9999999e-7, 5e-7, -5e-7, 0.1234565, -0.1234565, 1.0000005, 2.5e-6, 0.3, -0.9999999, 123456.7890125, None]
    bits = lambda v: None if v is None else struct.pack(">d", v)
    got = [bits(r[0]) for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(round_half_away(F.col("x"), 6)).collect()]
    want = [bits(duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]) for x in xs]
    assert got == want and got[1] == struct.pack(">d", -0.0)
