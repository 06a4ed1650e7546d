"""spark-submit entry: python -m loomgraph build|ingest|rank|gaps|stats|arms|evaluate|ablate|calibrate|migrate|serve ..."""

from __future__ import annotations

import argparse
import json

from .config import Config, load_env, session
from .operators import evaluation, linkcases, linking, paths
from .plans.arms import ARMS, GRID, ablate, head_to_head, report, run_arm, run_arms, sweep
from .plans.build import build
from .plans.engine import MatchEngine, set_engine
from .plans.tools import server
from .sources import readers
from .sources.store import Store


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--store", help="folder of the store (default: $LOOMGRAPH_STORE)")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("build", help="graph of a folder of taxonomy files, with vectors and similarity edges, into the store")
    a.add_argument("folder")
    a.add_argument("--neighbours", type=int, default=5)
    a.add_argument("--min-sim", type=float, default=0.30)
    a.add_argument("--max-density", type=float, default=0.15)
    a.add_argument("--dry-run", action="store_true")
    a = sub.add_parser("ingest", help="put a folder of documents into the pool")
    a.add_argument("folder")
    a.add_argument("--batch")
    a = sub.add_parser("rank", help="rank the pool for skills given as NAME or NAME=WEIGHT")
    a.add_argument("skills", nargs="+")
    a.add_argument("--batch")
    a.add_argument("--top", type=int)
    a = sub.add_parser("gaps", help="gaps of a profile: --have NAME ... --want NAME ...")
    a.add_argument("--have", nargs="+", required=True)
    a.add_argument("--want", nargs="+", required=True)
    sub.add_parser("stats", help="size of the graph")
    sub.add_parser("arms", help="evaluate the stored graph on the seeded dataset")
    a = sub.add_parser("evaluate", help="the arms, ablations and baselines on the seeded dataset, as Markdown")
    a.add_argument("--arm", action="append", choices=[n for n, x in ARMS.items() if x.get("graph") != "typed"], help="default: all that need no classified pairs")
    sub.add_parser("ablate", help="one-factor changes from the setting chosen on the training split")
    a = sub.add_parser("calibrate", help="correct, missed and wrong links by threshold, of a CSV of surface,expected or of the fixed cases")
    a.add_argument("cases", nargs="?")
    a = sub.add_parser("migrate", help="write an artifact (a folder of Parquet tables skills, roles, requires, similar) to the store")
    a.add_argument("artifact")
    a.add_argument("--dry-run", action="store_true")
    a = sub.add_parser("serve", help="a JSON server over the engine")
    a.add_argument("--port", type=int, default=8000)
    args = p.parse_args(argv)
    load_env()
    path = args.store or Config.from_env().store
    if not path:
        p.error("no store: use --store or LOOMGRAPH_STORE")
    spark = session()
    engine = MatchEngine(Store(spark, path))
    weights = lambda names: {n.partition("=")[0]: float(n.partition("=")[2] or 1) for n in names}
    if args.command == "build":
        build(engine.store, *readers.read_taxonomy(spark, args.folder), k=args.neighbours, min_sim=args.min_sim, max_density=args.max_density, dry_run=args.dry_run).show()
    elif args.command == "ingest":
        engine.ingest(readers.read_directory(spark, args.folder), args.batch).show(truncate=False)
    elif args.command == "rank":
        engine.rank_candidates(weights(args.skills), batch=args.batch, top_k=args.top).show(truncate=False)
    elif args.command == "gaps":
        engine.get_bridgeable_gaps(weights(args.want), weights(args.have)).show(truncate=False)
    elif args.command == "stats":
        engine.graph_stats().show()
    elif args.command in ("evaluate", "ablate"):
        wants, graded, have = evaluation.dataset(spark, evaluation.Generator().jds())
        similar = engine.store.read("similar")
        if args.command == "ablate":
            apsp = paths.apsp(similar)
            best = GRID[sweep(wants, graded.where("split = 'train'"), have, apsp).first()["config"]]
            print(report("Ablation", {json.dumps(best): ablate(wants, graded, have, apsp, best)}))
        else:
            names = args.arm or [n for n, x in ARMS.items() if x.get("graph") != "typed"]
            tables = {"Arms": run_arms(wants, graded, have, engine.nodes(), similar, names=names)}
            tables["Against the cosine baseline"] = head_to_head(wants, graded, have, engine.paths(), engine.params)
            print(report("Evaluation", tables))
    elif args.command == "calibrate":
        cases = spark.read.csv(args.cases, header=True, schema="surface string, expected string") if args.cases else linkcases.cases(spark)
        if lost := [r["name"] for r in linkcases.absent(cases, engine.nodes()).collect()]:
            p.error(f"the graph lacks {', '.join(lost)}")
        report_ = linkcases.table(linkcases.judged(cases, linking.Linker(engine.nodes()))).persist()
        report_.show(50)
        print(json.dumps({"chosen": linkcases.chosen(report_)}))
    elif args.command == "migrate":
        art = {t: spark.read.parquet(f"{args.artifact}/{t}") for t in ("skills", "roles", "requires", "similar")}
        engine.store.migrate(art, args.dry_run).show()
    elif args.command == "serve":
        set_engine(engine)
        server(engine, args.port).serve_forever()
    else:
        print(json.dumps(run_arm(engine.store.read("similar"), *evaluation.dataset(spark, evaluation.Generator().jds())), indent=2))


if __name__ == "__main__":
    main()
