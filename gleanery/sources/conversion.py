"""Office and PDF files through external tools; NULL whenever that does not work."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import PurePath

TIMEOUT_SECONDS = 60  # fixed value

# Which tool reads which suffix, and how it is called.
_PDF = ("pdftotext", "-layout", "{}", "-")
_WORD = ("textutil", "-convert", "txt", "-stdout", "{}")
TOOLS = {".pdf": _PDF, ".doc": _WORD, ".docx": _WORD, ".rtf": _WORD}


def _output(command: tuple[str, ...], path: str) -> str | None:
    if shutil.which(command[0]) is None:
        return None
    try:
        done = subprocess.run(
            [part.replace("{}", path) for part in command],
            capture_output=True, timeout=TIMEOUT_SECONDS, check=True,
        ).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    try:
        return done.decode("utf-8").strip() or None
    except UnicodeDecodeError:
        return done.decode("latin-1").strip() or None


def _word_paragraphs(path: str) -> str | None:
    try:
        from docx import Document

        return "\n\n".join(p.text for p in Document(path).paragraphs).strip() or None
    except Exception:  # the library is optional and files are arbitrary
        return None


def convert(path: str) -> str | None:
    suffix = PurePath(path).suffix.lower()
    text = _output(TOOLS[suffix], path) if suffix in TOOLS else None
    if text is None and suffix == ".docx":
        text = _word_paragraphs(path)
    return text
