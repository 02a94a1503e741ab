"""``python -m rillstone.stat --dir <path> stat``: counts of a log, without starting Spark."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from rillstone.sources.log import Log, Options


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rillstone.stat")
    parser.add_argument("--dir", required=True)
    parser.add_argument("command", choices=["stat"])
    given = parser.parse_args(args)
    if not Path(given.dir, "_log.json").exists():
        parser.error(f"{given.dir} is not a log")
    print(json.dumps(Log(None, Path(given.dir), Options(1)).stat()))


if __name__ == "__main__":
    main()
