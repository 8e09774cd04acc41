"""Command line: `python -m ledgerline acquire-lever ...` and `run-lever-pipeline ...`."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import urlsplit

from ledgerline.operators.policy import Policy, PolicyError, parse_policy
from ledgerline.operators.store import Store, StoreError
from ledgerline.run import Batch, acquire, process
from ledgerline.session import session
from ledgerline.sources.http import PostingsSource, SourceError

#: Fixed value: where the provider's postings are.
LEVER = "https://api.lever.co/v0/postings"


def not_blank(text: str) -> str:
    if not text.strip():
        raise argparse.ArgumentTypeError("must not be blank")
    return text.strip()


def above_zero(kind: type):
    def read(text: str):
        try:
            found = kind(text)
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text!r} is no {kind.__name__}") from None
        if not 0 < found < float("inf"):
            raise argparse.ArgumentTypeError("must be greater than zero")
        return found

    return read


def web_address(text: str) -> str:
    """HTTPS without query and fragment; plain HTTP on this machine, for tests."""
    found = text.strip().rstrip("/")
    parts = urlsplit(found)
    local = parts.scheme == "http" and parts.hostname in ("127.0.0.1", "localhost")
    if not (parts.scheme == "https" or local) or not parts.netloc or parts.query or parts.fragment:
        raise argparse.ArgumentTypeError("must be an HTTPS URL without query or fragment")
    return found


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="ledgerline")
    commands = made.add_subparsers(dest="command", required=True)
    for name, text in (("acquire-lever", "take one site's postings into a store"), ("run-lever-pipeline", "the same, then resolve identity and filter the catalog")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--site", required=True, type=not_blank)
        command.add_argument("--company", required=True, type=not_blank)
        command.add_argument("--store", required=True, help="URI of a folder that all machines share")
        command.add_argument("--api-base-url", default=LEVER, type=web_address)
        command.add_argument("--timeout-seconds", default=10.0, type=above_zero(float))
        command.add_argument("--page-size", default=100, type=above_zero(int))
    command.add_argument("--filter-policy", required=True, type=Path)
    return made


def load_policy(path: Path) -> Policy:
    try:
        return parse_policy(path.read_bytes())
    except OSError as error:
        raise PolicyError(f"cannot read {path}") from error


def main(arguments: Sequence[str] | None = None) -> int:
    """0, or 1 after a known error, which is printed; other errors are not caught."""
    a = parser().parse_args(arguments)
    try:
        rules = load_policy(a.filter_policy) if a.command == "run-lever-pipeline" else None  # before anything is fetched
        spark = session()
        spark.dataSource.register(PostingsSource)
        store = Store(spark, a.store).create()
        options = {"provider": "lever", "base_url": a.api_base_url, "scopes": json.dumps([a.site]), "page_size": str(a.page_size), "timeout": str(a.timeout_seconds)}
        batch: Batch = acquire(store, "lever", spark.read.format("postings").options(**options).load(), {a.site: a.company})
        if batch.failures:
            raise SourceError(f"{batch.failures[0][0]}: {batch.failures[0][1]}")
        if rules is None:
            print(f"Acquired and stored {batch.acquired} postings of {a.site!r} in {a.store}")
            return 0
        done = process(store, rules)
        print(f"Acquired {batch.acquired} postings; resolved {done.resolved}; evaluated {done.evaluated} active postings; {done.eligible} entities are eligible")
        return 0
    except (PolicyError, SourceError, StoreError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
