"""Command line: build, query and eval for vector indexes; remember, recall and fork for memory spaces."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .session import build as build_session
from .session import prepare


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recallforge")
    commands = p.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="index a vector file")
    b.add_argument("--vectors", required=True)
    b.add_argument("--output", required=True)
    for name, default in (("grains", 1), ("local-dim", None), ("sketch-dim", 0), ("residual-bits", 8), ("block-size", 64), ("shared-pq-subquantizers", None), ("shared-pq-bits", 8), ("split-at", None)):
        b.add_argument(f"--{name}", type=int, default=default)
    b.add_argument("--adaptive-target", type=float)
    b.add_argument("--shared-opq", action="store_true")
    b.add_argument("--enable-lattice-routing", action="store_true")
    b.add_argument("--routing-dim", type=int, default=6)
    b.add_argument("--spacing", type=float, default=1.0)
    for name in ("query", "eval"):
        q = commands.add_parser(name)
        q.add_argument("--index", required=True)
        q.add_argument("--queries", required=True)
        q.add_argument("--top-k", type=int, default=10)
        q.add_argument("--nprobe", type=int)
        q.add_argument("--rerank-factor", type=int)
        if name == "query":
            q.add_argument("--output")
        else:
            q.add_argument("--vectors", required=True)
            q.add_argument("--raw-rerank", action="store_true")
            q.add_argument("--candidate-k", type=int, default=100)
    for name in ("remember", "recall", "fork"):
        m = commands.add_parser(name)
        m.add_argument("--root", required=True)
        if name == "remember":
            m.add_argument("--records", required=True)
        elif name == "recall":
            m.add_argument("--query", required=True)
        else:
            m.add_argument("--name", required=True)
            m.add_argument("--manifest", required=True)
    return p


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = prepare(spark or build_session())
    from .index.index import GrainIndex, Options
    from .operators import knn
    from .sources import vectors as files

    if a.command == "build":
        rows = files.read_vecs(spark, a.vectors) if a.vectors.endswith("vecs") else files.read_matrix(spark, a.vectors)
        dim = len(rows.first()["embedding"])
        options = Options(a.local_dim or min(16, dim), a.sketch_dim, a.block_size, residual_bits=a.residual_bits, adaptive=a.adaptive_target, shared_parts=a.shared_pq_subquantizers, shared_bits=a.shared_pq_bits, shared_rotate=a.shared_opq, split_at=a.split_at)
        index = GrainIndex(spark, dim, options).build(rows, a.grains)
        if a.split_at:
            index.split_large()
        if a.enable_lattice_routing:
            from .routers.lattice import Lattice

            index.router = Lattice(index.centroids, a.routing_dim, a.spacing)
        index.save(a.output)
        print(f"built {rows.count()} vectors in {len(index.centroids)} grains", file=out)
    elif a.command in ("query", "eval"):
        index = GrainIndex.load(spark, a.index)
        if a.rerank_factor is not None:
            index.options.rerank_factor = a.rerank_factor
        queries = files.read_matrix(spark, a.queries, "queries")
        if a.command == "query":
            found = index.search_mode_a(queries, a.top_k, a.nprobe)
            if a.output:
                files.write_results(found, a.output)
            else:
                print("query_id,rank,vector_id,distance", file=out)
                for r in found.orderBy("query_id", "rank").toLocalIterator():
                    print(f"{r.query_id},{r.rank},{r.vec_id},{r.distance:.6f}", file=out)
        else:
            rows = files.read_matrix(spark, a.vectors)
            if a.raw_rerank:
                index.attach_raw_vectors(rows)
                found = index.search_mode_b(queries, a.top_k, a.candidate_k, a.nprobe)
            else:
                found = index.search_mode_a(queries, a.top_k, a.nprobe)
            share = knn.recall_at(found, knn.nearest(rows, queries, a.top_k), a.top_k).agg(F.avg("recall")).first()[0]
            print(f"recall@{a.top_k} = {share:.4f}", file=out)
    else:
        from .space import Collection

        with Collection(spark, a.root).space as space:
            if a.command == "remember":
                rows = files.read_jsonl(spark, a.records)
                space.insert_many(rows.drop("segment_id"))
                space.flush()
                print(f"remembered {rows.count()} records", file=out)
            elif a.command == "recall":
                for r in space.recall(files.read_query(spark, a.query)).collect():
                    print(json.dumps({"rank": r["rank"], "record_id": r.record_id, "score": r.score, "text": r.text}), file=out)
            else:
                child = space.fork(a.name, a.manifest)
                print(f"forked {child.manifest_id} from {child.parent_manifest_id}", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
