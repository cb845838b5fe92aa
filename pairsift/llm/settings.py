"""Production parameters of the registered queries and the pipeline."""

from __future__ import annotations

# target shares of bytes; all other sources share the rest
MIX_WEIGHTS = {"src0": 0.25, "src1": 0.10, "src2": 0.05, "src3": 0.05}
MIX_SEED = 1
# a repeated string is cut when it has so many bytes, or so many words in fewer bytes
REPEAT_BYTES = 256
REPEAT_WORDS = 50


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; every machine has the package that holds it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
