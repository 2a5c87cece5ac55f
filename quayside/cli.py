"""python -m quayside.cli: list queries, run one, run the stages over a folder of tables, and ask a run."""

from __future__ import annotations

import argparse
import json

from quayside.operators.retrieval import Search
from quayside.plans import catalogue
from quayside.plans.pipeline import dashboard, evidence, get_item, run_all, search
from quayside.plans.runs import Run, create_run, export, freeze, rebuild
from quayside.session import local_session, table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quayside")
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list")
    for name, args in (("query", ("name", "tables")), ("run-all", ("tables", "root", "run")), ("search", ("root", "run", "text")), ("status", ("root", "run")), ("freeze", ("root", "run")), ("insights", ("tables", "root", "run")), ("evidence", ("root", "run", "kind", "value")), ("item", ("root", "run", "id")), ("export", ("root", "run", "target")), ("rebuild", ("tables", "root", "run", "new"))):
        q = sub.add_parser(name)
        for a in args:
            q.add_argument(a)
    a = p.parse_args(argv)
    if a.do == "list":
        print("\n".join(catalogue.queries()))
        return 0
    spark = local_session("*")
    if a.do == "query":
        catalogue.queries()[a.name](spark, a.tables).show(50, truncate=80)
    elif a.do == "run-all":
        run = create_run(spark, a.root, a.run, {"tables": a.tables})
        print(json.dumps(run_all(run, *(table(spark, a.tables, t) for t in ("collected_item", "locale_zone", "taxonomy_node")))))
    elif a.do == "search":
        print(json.dumps(search(Run(spark, a.root, a.run), Search(a.text)), ensure_ascii=False, indent=1))
    elif a.do == "status":
        Run(spark, a.root, a.run).log().orderBy("kind", "stage").show(50, truncate=80)
    elif a.do == "insights":
        print(json.dumps(dashboard(Run(spark, a.root, a.run), table(spark, a.tables, "taxonomy_node")), ensure_ascii=False, indent=1, default=str))
    elif a.do == "evidence":
        evidence(Run(spark, a.root, a.run).read("tagged_item"), a.kind, a.value).show(50, truncate=80)
    elif a.do == "item":
        print(json.dumps(get_item(Run(spark, a.root, a.run), a.id), ensure_ascii=False, indent=1, default=str))
    elif a.do == "export":
        print("\n".join(export(Run(spark, a.root, a.run), a.target, ["collected_item", "feedback_item", "label", "category"], {"collected_item": ["raw_api_payload"]})))
    elif a.do == "rebuild":
        old = Run(spark, a.root, a.run)
        print(json.dumps(run_all(rebuild(old, a.new), old.read("collected_item"), *(table(spark, a.tables, t) for t in ("locale_zone", "taxonomy_node")), collected=True)))
    else:
        print(freeze(Run(spark, a.root, a.run)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
