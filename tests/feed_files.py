"""Feed files for tests."""

import os


def write_text(folder: str, name: str, text: str, newline: str = "\n") -> str:
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text.replace("\n", newline))
    return path
