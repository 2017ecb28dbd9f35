"""Vectors: scalar quantization, code arrays, casts, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANT_BITS = (32, 16, 8, 1)


def random_array(dim: int, low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Column:
    """A uniform vector for each row."""
    at = [F.rand(None if seed is None else seed + k) for k in range(dim)]
    return F.array(*[F.lit(low) + x * F.lit(high - low) for x in at])


def random_int_array(dim: int, low: int = 0, high: int = 1, seed: int | None = None) -> Column:
    return F.transform(random_array(dim, low, high + 1, seed), lambda x: F.floor(x).cast("int"))


def scalar_quantize(v: Column, bits: int) -> Column:
    """32: floats as they are; 16: rounded to 11 significant bits; 8: [-1, 1] to -100..100; 1: whether positive."""
    if bits in (2, 4):
        raise NotImplementedError("unimplemented quantization")
    if bits not in QUANT_BITS:
        raise ValueError(f"quant_bits must be one of {QUANT_BITS}")
    v = v.cast("array<double>")
    if bits == 32:
        return v.cast("array<float>")
    if bits == 16:

        def half(x: Column) -> Column:
            step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
            return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)

        return F.transform(v, half).cast("array<float>")
    if bits == 8:
        return F.transform(v, lambda x: F.greatest(F.lit(-100), F.least(F.lit(100), F.floor(x * 100 + 0.5).cast("int"))))
    return F.transform(v, lambda x: (x > 0).cast("int"))


def to_codes(values: Column) -> Column:
    """Checks an array of codes: not empty, every one 0..255; null stays null."""
    bad = F.exists(values, lambda x: x.isNull() | (x < 0) | (x > 255))
    kind = "array<smallint>"
    return F.when(values.isNull(), F.lit(None).cast(kind)).when(F.size(values) == 0, F.raise_error(F.lit("pqvec cannot be empty")).cast(kind)).when(bad, F.raise_error(F.lit("pqvec elements must be between 0 and 255")).cast(kind)).otherwise(values.cast(kind))


def codes_to_ints(codes: Column) -> Column:
    return codes.cast("array<int>")


def codes_to_text(codes: Column) -> Column:
    return F.to_json(codes_to_ints(codes))


def text_to_codes(text: Column) -> Column:
    return to_codes(F.from_json(F.translate(text, "{}", "[]"), "array<int>"))


def codes_to_bytes(codes: Column) -> Column:
    """Two bytes for the number of codes, then a byte each."""
    head = F.lpad(F.hex(F.size(codes)), 4, "0")
    return F.unhex(F.concat(head, F.array_join(F.transform(codes, lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), "")))


def bytes_to_codes(data: Column) -> Column:
    digits = F.substring(F.hex(data), 5, 1 << 20)
    at = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    return to_codes(F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int")))


def parse_vector(text: Column, kind: str = "float") -> Column:
    """A vector of its literal, ``{1,2}`` or ``[1,2]``."""
    return F.from_json(F.translate(text, "{}", "[]"), f"array<{kind}>")


def try_cast(text: Column, kind: str) -> Column:
    """The value as ``kind``, null where it isn't one; arrays and structs are read as JSON."""
    return F.from_json(text, kind) if kind.lower().startswith(("array", "struct", "map")) else text.try_cast(kind)


def mask_arrays(text: Column) -> Column:
    """Vector literals become ``[MASKED_VECTOR]``."""
    return F.regexp_replace(text, r"[\[{]\s*-?[0-9][0-9eE.+\-]*(?:\s*,\s*-?[0-9][0-9eE.+\-]*)*\s*[\]}]", "[MASKED_VECTOR]")
