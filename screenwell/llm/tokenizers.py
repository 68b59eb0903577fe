"""Where the public tokenizer files are; their folder is a parameter."""

from __future__ import annotations

import os


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The file `name` in `folder`, by default in the folder of the installed public_tokenizers package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
