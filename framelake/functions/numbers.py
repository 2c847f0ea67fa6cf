"""Lines of numbers in Arrow batches: one scan for the tokens, one conversion for each distinct token.

A line of a matrix holds hundreds of tokens, mostly a few class ids over and over. A cast per token in
the JVM is interpreted; here the tokens of a batch are encoded as a dictionary, its plain numbers are converted
in bulk and only odd words are looked at one by one.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that the bulk conversion takes; what else may be one is tried word by word.
_PLAIN = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
#: Characters of an ordinary number, and words that are numbers whatever their case.
_ORDINARY = frozenset("-+.0123456789eE")
_NAMED = frozenset(sign + word for sign in ("", "+", "-") for word in ("inf", "infinity", "nan"))


def _odd_number(word: str | None) -> float | None:
    """A number as :func:`framelake.functions.text.to_number` reads it; None for anything else."""
    if word is None or not (_ORDINARY.issuperset(word) or word.lower() in _NAMED):
        return None
    try:
        return float(word)
    except ValueError:
        return None


def word_values(words: pa.Array) -> pa.Array:
    """Doubles for an array of words; NULL where a word is no number."""
    plain = pc.fill_null(pc.match_substring_regex(words, _PLAIN), False)
    values = pc.cast(pc.if_else(plain, words, None), pa.float64())
    odd = pc.indices_nonzero(pc.invert(plain))
    if not len(odd):
        return values
    found = pa.array([_odd_number(w) for w in words.take(odd).to_pylist()], pa.float64())
    return pc.replace_with_mask(values, pc.invert(plain), found)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def parse_numbers(lines: pa.Array) -> pa.Array:
    """The tokens between white space of each line as doubles; NULL for words and for a NULL line's list."""
    tokens = pc.ascii_split_whitespace(lines)
    encoded = tokens.flatten().dictionary_encode()
    values = word_values(encoded.dictionary).take(encoded.indices)
    return pa.ListArray.from_arrays(tokens.offsets, values, mask=tokens.is_null() if tokens.null_count else None)
