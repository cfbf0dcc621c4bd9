"""One local session and small fictitious sources."""

from __future__ import annotations

import base64
import os
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from gleanery.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gleanery-tests", "local[*]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


MESSAGES = {
    "2024/3/7/aa01.eml": b"""From: Nora Field <Nora.Field+sales@Example.org>
To: Omar Lund <omar@lund.example>, "Pia, of Lund" <pia@lund.example>
Subject: Quote QX-2024-0417
Date: Thu, 07 Mar 2024 10:41:20 +0100
Message-ID: <aa01@example.org>
Content-Type: text/plain; charset=us-ascii

The quote QX-2024-0417 covers invoicing for the lighthouse.

On Wed, 6 Mar 2024, Omar Lund wrote:
> when will the quote arrive
""",
    "2024/3/7/aa02.eml": b"""From: omar@lund.example
To: nora.field@example.org
Cc: Archive <archive@example.org>
Subject: Re: Quote
Date: Thu, 07 Mar 2024 12:00:00 +0000
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary=b1

--b1
Content-Type: text/plain

Plain wins over markup.
--b1
Content-Type: text/html

<p>markup loses</p>
--b1--
""",
    "2024/11/2/aa03.eml": b"""From: Nora Field <nora.field@example.org>
To: omar@lund.example
Subject: Newsletter
Date: Sat, 02 Nov 2024 08:00:00 +0000
MIME-Version: 1.0
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: base64

""" + base64.encodebytes("<style>p{}</style><script>x()</script><p>Fish &amp; chips</p><div>café</div>".encode()),
    "2025/1/6/aa04.eml": b"""From: Nora Field <nora.field@example.org>
To: omar@lund.example
Bcc: hidden@lund.example
Reply-To: desk@example.org
Subject: Figures
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b2

--b2
Content-Type: text/plain

See the sheet.
--b2
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="figures.xlsx"
Content-Transfer-Encoding: base64

UEsDBA==
--b2--
""",
    "2023/6/9/aa05.eml": b"""From: =?iso-8859-1?q?Zo=EB_Quist?= <zoe@quist.example>
To: nora.field@example.org
Subject: =?iso-8859-1?q?Fee_of_=A340?=
Date: Fri, 09 Jun 2023 09:00:00 +0000
Content-Type: text/plain; charset=iso-8859-1

Caf\xe9 fee is \xa340.
""",
    "2025/2/1/aa06.eml": b"""From: nora.field@example.org
To: omar@lund.example
Subject: Empty
Date: Sat, 01 Feb 2025 09:00:00 +0000

> only a quoted line
""",
}

FILES = {
    "finance/summary.txt": "Annual summary — lighthouse repairs and invoices.\n\nSecond paragraph.".encode(),
    "finance/ledger.csv": b"Date,Description\n2024-01-01,Lamp oil\n2024-01-02,Rope\n",
    "finance/return.pdf": b"%PDF-1.4\nnot really\n",
    "minutes/march.md": b"# March\n\nBoard met about Acme Corp.\n\n## Actions\n\nBuy rope.\n",
    "minutes/notice.html": b"<html><style>x</style><body><p>Annual  notice</p><p>Tea &amp; cake</p></body></html>",
    "tool.py": b"import os\n\ndef lamp():\n    return 'lit'\n",
    ".hidden.txt": b"hidden words",
    "_under.txt": b"under words",
    "empty.txt": b"",
    "latin.txt": b"caf\xe9 lighthouse",
    "blob.txt": b"a\x00b",
    ".git/config": b"ignored",
    "msg-db.sqlite": b"ignored",
}


def write_tree(root: Path, files: dict[str, bytes]) -> Path:
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def make_repo(root: Path) -> Path:
    root.mkdir(parents=True)
    env = {
        **os.environ, "GIT_AUTHOR_NAME": "Nora Field", "GIT_AUTHOR_EMAIL": "Nora.Field@example.org",
        "GIT_COMMITTER_NAME": "Nora Field", "GIT_COMMITTER_EMAIL": "nora.field@example.org",
        "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null",
    }

    def git(*args: str, day: int = 1) -> None:
        stamp = f"2024-04-{day:02d}T10:00:00+02:00"
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True,
                       env={**env, "GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp})

    git("init", "-q", "-b", "main")
    write_tree(root, {"docs/prices.md": b"# Prices\n\nLamp oil costs more.\n"})
    git("add", "-A")
    git("commit", "-q", "-m", "Add prices", day=1)
    write_tree(root, {"scripts/bill.py": b"def bill():\n    return 40\n"})
    git("add", "-A")
    git("commit", "-q", "-m", "Add billing script\n\nIt prints the lighthouse bill.", day=2)
    write_tree(root, {"docs/prices.md": b"# Prices\n\nLamp oil costs less.\n"})
    git("add", "-A")
    git("commit", "-q", "-m", "Lower prices", day=3)
    return root


def label_db(path: Path, joined: bool) -> None:
    with sqlite3.connect(path) as db:
        if joined:
            db.execute("CREATE TABLE messages (message_num INTEGER, message_filename TEXT)")
            db.execute("CREATE TABLE labels (message_num INTEGER, label TEXT)")
            db.execute("INSERT INTO messages VALUES (1, '2024/3/7/aa01.eml'), (2, '2024/3/7/aa02.eml')")
            db.execute("INSERT INTO labels VALUES (1, 'INBOX'), (1, 'Quotes'), (2, 'Sent')")
        else:
            db.execute("CREATE TABLE uids (message_num INTEGER, message_filename TEXT, labels TEXT)")
            db.execute("INSERT INTO uids VALUES (1, '2024/3/7/aa01.eml', 'INBOX, Quotes'), (2, 'aa02.eml', '')")


CONFIG = """db = "index"

[[sources]]
name = "files"
type = "filetree"
root = "files"

[[sources]]
name = "mail"
type = "eml_tree"
root = "mail"

[[sources]]
name = "repo"
type = "gitrepo"
root = "repo"

[entities]
seeds = "seeds.toml"
aliases = "aliases.toml"
"""


def make_corpus(root: Path) -> Path:
    write_tree(root / "files", FILES)
    write_tree(root / "mail", MESSAGES)
    label_db(root / "mail" / "msg-db.sqlite", joined=True)
    make_repo(root / "repo")
    (root / "gleanery.toml").write_text(CONFIG)
    (root / "seeds.toml").write_text('persons = ["Nora Field"]\norgs = ["Quote"]\n')
    (root / "aliases.toml").write_text(
        '[alias_of]\n"Nora.Field+old@example.org" = "Nora Field"\n[member_of]\n"Nora Field" = "Harbour Trust"\n'
    )
    return root


@pytest.fixture(scope="session")
def corpus(tmp_path_factory):
    return make_corpus(tmp_path_factory.mktemp("corpus"))
