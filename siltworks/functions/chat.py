"""Chat rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of the chat format.
START, END, TURN = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"


def render(messages: Column, prompt: bool = False) -> Column:
    """The text of an array of (role, content) in order; with prompt, the header of an answer to come. Null content is empty."""
    one = F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit(END + "\n\n"), F.coalesce(m["content"], F.lit("")), F.lit(TURN)))
    return F.concat(F.array_join(one, ""), F.lit(f"{START}assistant{END}\n\n" if prompt else ""))
