"""The command line: ingest, chunk, index, query, eval, worker, jobs, job-status. [Q14-Q20]"""

from __future__ import annotations

import argparse
import json
import signal
import sys

from lodeseek.operators.images import MODES as OCR_MODES
from lodeseek.plans.planner import MERGE_STRATEGIES
from lodeseek.plans.retrieve import INDEXES, MODES


def positive(text: str) -> int:
    if (n := int(text)) <= 0:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return n


def planner_flags(c: argparse.ArgumentParser) -> None:
    c.add_argument("--planner-merge-strategy", choices=MERGE_STRATEGIES)
    c.add_argument("--planner-rerank", action=argparse.BooleanOptionalAction)
    c.add_argument("--planner-route-vote-bonus", type=float)
    c.add_argument("--planner-rerank-overlap-weight", type=float)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeseek")
    p.add_argument("--store", help="root folder of the store")
    p.add_argument("--encoders", help="module:function from (model, device) to the page and question encoders of a page model")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *positional: [(c := sub.add_parser(name)), [c.add_argument(a) for a in positional]][0]
    c = add("ingest", "path")
    c.add_argument("--ocr", help="module:factory of the OCR engines; the factory gives (local, cloud)")
    c.add_argument("--mode", choices=OCR_MODES)
    c.add_argument("--dpi", type=positive)
    c.add_argument("--async", dest="later", action="store_true")
    c = add("chunk", "document_id")
    c.add_argument("--max-words", type=positive)
    c.add_argument("--overlap-words", type=int)
    c.add_argument("--async", dest="later", action="store_true")
    c = add("index", "document_id")
    c.add_argument("--mode", choices=sorted(INDEXES), default="all")
    c.add_argument("--visual-backend", choices=["baseline", "colpali"])
    c.add_argument("--visual-compression", choices=["none", "int8"])
    c.add_argument("--colpali-model")
    c.add_argument("--device")
    c.add_argument("--async", dest="later", action="store_true")
    c = add("query", "question")
    c.add_argument("--document-id")
    c.add_argument("--top-k", type=positive)
    c.add_argument("--mode", choices=MODES)
    planner_flags(c)
    c = add("eval", "manifest")
    c.add_argument("--top-k", type=positive, default=5)
    c.add_argument("--modes", nargs="+", choices=MODES, default=["bm25", "dense", "hybrid", "planner"])
    c.add_argument("--planner-sweep", action="store_true")
    planner_flags(c)
    c = add("worker")
    c.add_argument("--poll-interval", type=float, default=None, help="seconds between two looks at the queue; the setting stands in")
    c.add_argument("--once", action="store_true", help="ends when the jobs that are there have run")
    c = add("jobs")
    c.add_argument("--status")
    add("job-status", "job_id")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from lodeseek.api import Engine, NotFoundError
    from lodeseek.operators.evaluate import markdown
    from lodeseek.session import session
    from lodeseek.sources.config import factory, settings

    engine = Engine(spark or session(), a.store, factory(a.encoders) if a.encoders else None)
    try:
        if getattr(a, "later", False):
            # every flag that was given travels with the job; names of factories are looked up by the worker
            print(engine.queue.submit(a.command, {k: v for k, v in vars(a).items() if v is not None and k not in ("command", "store", "later", "encoders")}))
        elif a.command == "ingest":
            given = {"engines": factory(a.ocr) if a.ocr else None, "mode": a.mode, "dpi": a.dpi}
            print(engine.ingest(a.path, **{k: v for k, v in given.items() if v is not None}))
        elif a.command == "chunk":
            print(engine.chunk(a.document_id, a.max_words, a.overlap_words))
        elif a.command == "index":
            print(*engine.index(a.document_id, a.mode, a.visual_backend, a.visual_compression, a.colpali_model, a.device), sep="\n")
        elif a.command == "query":
            given = {"strategy": a.planner_merge_strategy, "rerank": a.planner_rerank, "vote_bonus": a.planner_route_vote_bonus, "overlap_weight": a.planner_rerank_overlap_weight}
            print(json.dumps(engine.query(a.question, a.document_id, a.top_k, a.mode, **{k: v for k, v in given.items() if v is not None}), indent=2, ensure_ascii=False, default=str))
        elif a.command == "eval":
            given = {"planner_merge_strategy": a.planner_merge_strategy, "planner_rerank": a.planner_rerank, "planner_route_vote_bonus": a.planner_route_vote_bonus, "planner_rerank_overlap_weight": a.planner_rerank_overlap_weight, "planner_sweep": a.planner_sweep or None}
            print(markdown(engine.evaluate(a.manifest, a.top_k, tuple(a.modes), **{k: v for k, v in given.items() if v is not None})))
        elif a.command == "worker":
            query = engine.work(None if a.once else a.poll_interval or settings().job_poll_interval)
            stop = lambda *_: query.stop()  # noqa: E731 the job that runs ends first
            before = {s: signal.signal(s, stop) for s in (signal.SIGINT, signal.SIGTERM)}
            query.awaitTermination()
            for s, handler in before.items():
                signal.signal(s, handler)
        elif a.command == "jobs":
            for r in engine.queue.jobs(a.status).collect():
                print(r["job_id"], r["status"])
        else:
            print(json.dumps(engine.job(a.job_id), indent=2, default=str))
    except NotFoundError as e:
        print(e, file=sys.stderr)
        return 1 if a.command == "job-status" else 2
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
