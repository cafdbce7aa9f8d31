"""python -m newsloom SYMBOL... --tables DIR: verdict documents as JSON."""

from __future__ import annotations

import argparse
import json

from newsloom.api import News
from newsloom.session import session


def main() -> None:
    p = argparse.ArgumentParser(prog="newsloom")
    p.add_argument("symbols", nargs="+")
    p.add_argument("--tables", required=True, help="folder of the Parquet tables")
    p.add_argument("--master", default=None)
    args = p.parse_args()
    spark = session(master=args.master)
    print(json.dumps(News(spark, args.tables).run(args.symbols), ensure_ascii=False, indent=2))
    spark.stop()


if __name__ == "__main__":
    main()
