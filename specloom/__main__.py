"""python -m specloom COMMAND ...: every command with its parameters as --name value."""

from __future__ import annotations

import argparse
import inspect
import json
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession

from specloom.plans import commands, presets

COMMANDS = {
    "digest": commands.digest_fasta, "predict": commands.predict_table, "predict-chunked": commands.predict_chunked, "build": commands.build,
    "predict-rt": commands.predict_rt, "add-rt": commands.add_rt, "max-n": commands.max_n, "union": commands.union, "consensus": commands.consensus,
    "random-n": commands.random_n, "reverse-intensity": commands.reverse_intensity,
}


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="specloom")
    parser.add_argument("command", choices=["presets", *COMMANDS])
    parser.add_argument("--verbose", action="store_true")
    known, rest = parser.parse_known_args(args)
    logging.basicConfig(level=logging.INFO if known.verbose else logging.WARNING)
    if known.command == "presets":
        for row in presets.table():
            print(json.dumps(row))
        return 0
    if len(rest) % 2 or any(not x.startswith("--") for x in rest[::2]):
        parser.error("options are given as --name value")
    options = {k[2:].replace("-", "_"): _value(v) for k, v in zip(rest[::2], rest[1::2], strict=True)}
    f = COMMANDS[known.command]
    spark = SparkSession.builder.appName("specloom").getOrCreate()
    try:
        inspect.signature(f).bind(spark, **options)
    except TypeError as e:
        parser.error(str(e))
    print(json.dumps(f(spark, **options), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
