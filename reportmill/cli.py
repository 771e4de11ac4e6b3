"""Command line: process one report. Exit code 0, or 1 where anything failed."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from reportmill import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("reportmill", description="Scanner reports to tables, statistics and consolidated findings")
    p.add_argument("-i", "--input", required=True, help="a file, or a folder or pattern in any store")
    p.add_argument("-t", "--type", default="auto", help="kind of report: auto, vuln or net")
    p.add_argument("-of", "--output-folder", default="output")
    p.add_argument("-on", "--output-name", help="name of the parsed report; other results add their kind to its stem")
    p.add_argument("-c", "--consolidate", action="store_true")
    p.add_argument("-a", "--api-format", action="store_true", help="findings ready for a report; needs -c")
    p.add_argument("-r", "--rules-file")
    p.add_argument("-el", "--entity-limit", type=int)
    p.add_argument("--log-exclusions", action="store_true", help="write why plugins were left out")
    p.add_argument("-s", "--port-status", default="all")
    p.add_argument("-fj", "--flat-json", action="store_true")
    p.add_argument("--documents", action="store_true", help="also write single JSON documents")
    p.add_argument("--large-documents", action="store_true", help="also write them, of any size and to any store, by the executors")
    p.add_argument("--strict", action="store_true", help="check suffix, root and well-formedness first")
    p.add_argument("--no-output", action="store_true")
    p.add_argument("--no-colour", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    from reportmill import api, display
    from reportmill.sources import detect

    log = api.setup_logging()
    colour = sys.stdout.isatty() and not o.no_colour
    print(display.banner(__version__, colour))
    if o.api_format and not o.consolidate:
        log.error("--api-format needs --consolidate")
        return 1
    if o.entity_limit is not None and o.entity_limit < 1:
        log.error("--entity-limit must be 1 or more")
        return 1
    # Only of a kind that was named: one that is detected may differ from what was expected.
    if unused := api.ignored_options(o.type, vars(o)):
        log.warning("ignored for %s: %s", o.type, ", ".join("--" + x.replace("_", "-") for x in unused))
    from pyspark.sql import SparkSession

    try:
        spark = SparkSession.builder.appName("reportmill").getOrCreate()
        kind = o.type
        if kind == "auto":
            kind = detect.detect(o.input) if Path(o.input).is_file() else detect.detect_in_store(spark, o.input)
            print(f"kind: {display.paint(kind, 'green', colour)}")
        folder = None if o.no_output else o.output_folder
        results = api.process(spark, o.input, kind, o.port_status, o.consolidate, o.api_format, o.rules_file, o.entity_limit, folder, o.output_name, o.flat_json, o.strict, o.log_exclusions, "large" if o.large_documents else o.documents)
        print(display.summaries(results, colour))
        api.release(results)
        failed = [k for k, ok in results.get("written", {}).items() if not ok]
        if failed:
            log.warning("not written: %s", ", ".join(failed))
        return int(bool(failed))
    except Exception as e:  # every failure is an exit code here
        log.error("%s: %s", type(e).__name__, str(e).split("\n", 1)[0])
        return 1


if __name__ == "__main__":
    sys.exit(main())
