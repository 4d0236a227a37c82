"""cairnflow run|drift|score --config FILE, and cairnflow smoke. Exit codes: 0 done, 1 failed, 2 usage, 3 drift flagged."""

from __future__ import annotations

import argparse
import sys
import tempfile
from pathlib import Path

from .config import load_config
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairnflow", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "drift", "score"):
        c = sub.add_parser(name)
        c.add_argument("--config", required=True)
        c.add_argument("--out", type=Path)
    sub.add_parser("smoke").add_argument("--out", type=Path)
    args = p.parse_args(argv)
    from . import pipeline

    try:
        spark = local_session()
        if args.command == "smoke":
            files, flagged = pipeline.run_smoke(spark, args.out or Path(tempfile.mkdtemp())), []
        else:
            cfg = load_config(args.config)
            got = {"run": pipeline.run_benchmark, "drift": pipeline.run_drift, "score": pipeline.run_score}[args.command](spark, cfg, args.out)
            files, flagged = got if isinstance(got, tuple) else (got, [])
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for k, v in files.items():
        print(f"{k}: {v}")
    return 3 if flagged else 0


if __name__ == "__main__":
    sys.exit(main())
