"""JSON texts that are one value and nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = "end of the text 7c9e6679"


def strict_json(text: Column) -> Column:
    """The text as VARIANT; NULL where it is not JSON from its first to its last character.

    The parser alone stops after the first value, whatever follows.  So the text is
    parsed as the first element of an array whose second and last is a mark.
    """
    framed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))

    def whole(array: Column) -> Column:
        marked = F.try_variant_get(array, "$[1]", "string") == _END
        return F.coalesce(marked & F.try_variant_get(array, "$[2]", "variant").isNull(), F.lit(False))

    # A filter over one element, so that the text is parsed once.
    return F.try_variant_get(F.get(F.filter(F.array(framed), whole), 0), "$[0]", "variant")
