"""Command line: build, board, lookup, find, terms, export over a token index."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflux.operators import company, kwic, match, overlap, score, sparse
from lexiflux.operators.lexicon import TIERS, Term, compile_terms, terms_frame, with_added
from lexiflux.sources import index, readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiflux")
    p.add_argument("--index", required=True)
    p.add_argument("--lexicon")
    p.add_argument("--companies")
    scoring = argparse.ArgumentParser(add_help=False)
    scoring.add_argument("--add", action="append", default=[])
    scoring.add_argument("--only-added", action="store_true")
    scoring.add_argument("--tier", choices=TIERS, default="puffery")
    scoring.add_argument("--sources", choices=company.SOURCES, default="auto")
    as_json = argparse.ArgumentParser(add_help=False)
    as_json.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--txt-dir", action="append", required=True)
    b = sub.add_parser("board", parents=[scoring, as_json])
    b.add_argument("--top", type=int, default=25)
    b.add_argument("--min-words", type=int, default=company.MIN_WORDS)
    b.add_argument("--reverse", action="store_true")
    b.add_argument("--metric", choices=company.METRICS, default=company.METRICS[0])
    b = sub.add_parser("lookup", parents=[scoring, as_json])
    b.add_argument("company")
    b.add_argument("--min-words", type=int, default=company.MIN_WORDS)
    b = sub.add_parser("find", parents=[as_json])
    b.add_argument("term")
    b.add_argument("--regex", action="store_true")
    b.add_argument("--top", type=int, default=15)
    b.add_argument("--examples", type=int, default=10)
    sub.add_parser("terms", parents=[as_json])
    b = sub.add_parser("export", parents=[scoring])
    b.add_argument("out")
    b.add_argument("--by", choices=("report", "company"), default="company")
    return p


def _emit(args: argparse.Namespace, payload: dict) -> None:
    if args.json:
        json.dump(payload, sys.stdout, indent=2, ensure_ascii=False)
        print()
        return
    for k, v in payload.items():
        if isinstance(v, list):
            print(f"{k}:")
            for row in v:
                print("  " + ("  ".join(f"{x}" for x in row.values()) if isinstance(row, dict) else str(row)))
        else:
            print(f"{k}: {v}")


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Scored:
    """Documents, terms and spans of one command."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        docs, _ = index.read(spark, args.index)
        lexicon = readers.lexicon(spark, args.lexicon) if args.lexicon else []
        self.terms = with_added(lexicon, args.add, args.only_added, args.tier)
        if not self.terms:
            sys.exit("no terms to score")
        compiled = compile_terms(self.terms)
        for t, error in compiled.errors.items():
            print(f"skipped {self.terms[t].label}: {error}", file=sys.stderr)
        self.errors = compiled.errors
        self.docs, self.frame = docs, terms_frame(spark, self.terms)
        self.raw = match.spans(docs, compiled)
        self.kept = overlap.resolve(self.raw)
        self.counted = score.counts(self.kept)
        dim = readers.companies(spark, args.companies) if args.companies else spark.createDataFrame([], readers.COMPANY_SCHEMA)
        self.rollup = company.decorated(company.rollup(docs, self.counted, self.frame, args.sources), dim)

    def added(self) -> list[dict]:
        """What each added word brings; a row has an error only where the word could not be used."""
        rows = _dicts(sparse.added_word_stats(self.raw, self.kept, self.frame, self.errors)) if any(t.extra for t in self.terms) else []
        return [{k: v for k, v in r.items() if k != "error" or v} for r in rows]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexiflux").getOrCreate()
    if args.command == "build":
        docs = readers.text_folders(spark, args.txt_dir)
        if args.companies:
            docs = docs.join(readers.companies(spark, args.companies, last=False).select("symbol", "company"), "symbol", "left").fillna("", ["company"])
        index.build(docs, args.index)
    elif args.command == "board":
        s = Scored(spark, args)
        rows = _dicts(company.board(s.rollup, args.metric, args.top, args.min_words, args.reverse))
        _emit(args, {"metric": args.metric, "rows": rows, "added": s.added()})
    elif args.command == "lookup":
        s = Scored(spark, args)
        found = company.resolve(s.rollup, [args.company]).collect()
        if not found:
            sys.exit(f"no company matches {args.company!r}")
        ranked = company.lookup_rank(s.rollup, args.min_words).where(F.col("symbol") == found[0]["symbol"])
        _emit(args, {"company": _dicts(ranked), "files": [r["file"] for r in company.files(s.docs, args.sources).where(F.col("symbol") == found[0]["symbol"]).collect()], "added": s.added()})
    elif args.command == "find":
        docs, _ = index.read(spark, args.index)
        compiled = compile_terms([Term(args.term, "puffery", args.term, "regex" if args.regex else "plain")])
        if compiled.errors:
            sys.exit(f"cannot use {args.term!r}: {compiled.errors[0]}")
        found = match.spans(docs, compiled)
        _emit(args, {"term": args.term, "total_hits": found.count(), "top": _dicts(kwic.by_symbol(found, docs, args.top)), "examples": _dicts(kwic.concordance(found, docs, args.examples))})
    elif args.command == "terms":
        if not args.lexicon:
            sys.exit("terms needs --lexicon")
        terms = readers.lexicon(spark, args.lexicon)
        _emit(args, {"terms": [vars(t) for t in terms], "tiers": [{"tier": t, "n": sum(x.tier == t for x in terms)} for t in TIERS]})
    elif args.command == "export":
        s = Scored(spark, args)
        if args.by == "company":
            sinks.write_csv(s.rollup, args.out)
        else:
            names = s.docs.groupBy("symbol").agg(F.max("company").alias("company"))
            sinks.write_csv(score.full_rows(s.docs, s.counted, s.frame, names), args.out)


if __name__ == "__main__":
    main()
