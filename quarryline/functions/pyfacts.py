"""What Python source says about workflows and jobs, from its syntax tree alone; nothing is run."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from quarryline.functions.sqlfacts import sql_facts

AIRFLOW = "struct<dags:array<struct<dag:string,has_docs:boolean>>,tasks:array<struct<dag:string,task:string,operator:string,sql:string>>,edges:array<struct<source:string,target:string>>>"
SPARK = "struct<has_docs:boolean,reads:array<string>,writes:array<string>>"
#: Methods that read and that write, by the last name of a chain.
READS = ("load", "parquet", "csv", "json")
WRITES = ("saveAsTable", "insertInto", "parquet", "csv", "json", "save")


def tree_of(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError):
        return None


def called(call: ast.expr) -> str:
    """The last name of what is called."""
    if not isinstance(call, ast.Call):
        return ""
    return getattr(call.func, "id", None) or getattr(call.func, "attr", None) or ""


def string(node: ast.expr | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def keyword(call: ast.Call, name: str) -> str | None:
    return next((string(k.value) for k in call.keywords if k.arg == name and string(k.value) is not None), None)


def dag_of(call: ast.Call) -> tuple[str, bool] | None:
    """A DAG's id and whether it is documented."""
    name = keyword(call, "dag_id") or (string(call.args[0]) if call.args else None)
    if not name:
        return None
    notes = {k.arg: k.value for k in call.keywords if k.arg in ("doc_md", "doc")}
    for key in ("doc_md", "doc"):
        if isinstance(notes.get(key), ast.JoinedStr):
            return name, True
        if string(notes.get(key)) is not None:
            return name, bool(string(notes[key]).strip())
    return name, False


def leaves(node: ast.expr, chains: bool) -> list[str]:
    """Names in an expression of dependencies, in order."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.List):
        return [x for y in node.elts for x in leaves(y, chains)]
    if chains and isinstance(node, ast.BinOp) and isinstance(node.op, ast.RShift | ast.LShift):
        return leaves(node.left, chains) + leaves(node.right, chains)
    return []


def events(node: ast.AST) -> Iterator[tuple]:
    """What matters, in the order in which the source says it: ("dag", call), ("leave",) at the end of a with block
    that began with ("enter",), ("task", call, variables) and ("link", before, after)."""
    if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
        if called(node.value) == "DAG":
            yield "dag", node.value
        elif called(node.value).endswith("Operator") or called(node.value) == "TaskGroup":
            yield "task", node.value, [x.id for x in node.targets if isinstance(x, ast.Name)]
    elif isinstance(node, ast.With):
        yield ("enter",)
        for item in node.items:
            if called(item.context_expr) == "DAG":
                yield "dag", item.context_expr
    elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.RShift | ast.LShift):
        sides = leaves(node.left, True), leaves(node.right, True)
        yield "link", *(sides if isinstance(node.op, ast.RShift) else sides[::-1])
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("set_downstream", "set_upstream"):
        sides = leaves(node.func.value, False), [x for a in node.args for x in leaves(a, False)]
        yield "link", *(sides if node.func.attr == "set_downstream" else sides[::-1])
    for child in ast.iter_child_nodes(node):
        yield from events(child)
    if isinstance(node, ast.With):
        yield ("leave",)


def airflow(path: str, content: str) -> list[dict]:
    """One struct with DAGs, tasks (full names are dag.task) and edges; nothing if the file has neither or can't be parsed."""
    tree = tree_of(content)
    dags: dict[str, bool] = {}
    tasks: dict[str, dict] = {}
    variables: dict[str, str] = {}
    links: set[tuple[str, str]] = set()
    now, around = None, []
    for what, *x in events(tree) if tree else ():
        if what == "enter":
            around.append(now)
        elif what == "leave":
            now = around.pop()
        elif what == "dag":
            if found := dag_of(x[0]):
                now = found[0]
                dags[now] = found[1]
        elif what == "task":
            if task := keyword(x[0], "task_id"):
                tasks.setdefault(task, {"dag": now or "unknown_dag", "task": task, "operator": called(x[0]), "sql": keyword(x[0], "sql") or ""})
                variables |= dict.fromkeys(x[1], task)
        else:
            known = [[y for z in side if (y := variables.get(z, z if z in tasks else None))] for side in x]
            links |= {(a, b) for a in known[0] for b in known[1]}
    if not dags and not tasks:
        return []
    full = {t: f"{x['dag']}.{t}" for t, x in tasks.items()}
    edges = [(tasks[t]["dag"], full[t]) for t in sorted(tasks)] + [(full[a], full[b]) for a, b in sorted(links) if a in full and b in full]
    return [{"dags": [{"dag": d, "has_docs": dags[d]} for d in sorted(dags)], "tasks": [tasks[t] for t in sorted(tasks)], "edges": [{"source": a, "target": b} for a, b in edges]}]


def chain(node: ast.expr) -> str:
    """The names of a chain of calls and attributes, as in spark.read.format.load."""
    if isinstance(node, ast.Call):
        return chain(node.func)
    if isinstance(node, ast.Attribute):
        return f"{before}.{node.attr}" if (before := chain(node.value)) else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def calls(node: ast.AST) -> Iterator[ast.Call]:
    """Outer calls before those inside them, in the order of the source."""
    if isinstance(node, ast.Call):
        yield node
    for child in ast.iter_child_nodes(node):
        yield from calls(child)


def spark_job(path: str, content: str) -> list[dict]:
    """One struct with what the job reads and writes, each once, first seen first; nothing if there is neither."""
    tree = tree_of(content)
    if tree is None:
        return []
    reads: dict[str, None] = {}
    writes: dict[str, None] = {}
    for call in calls(tree):
        name, first = chain(call), string(call.args[0]) if call.args else None
        last = name.rpartition(".")[2]
        if not first:
            continue
        if name.startswith(("spark.read", "spark.table")):
            if name == "spark.table" or last in READS or (last == "table" and "read" in name):
                reads.setdefault(first)
        elif name == "spark.sql":
            for statement in sql_facts(first):
                made = [statement["target"]] if statement["target"] else []
                reads |= dict.fromkeys(made + statement["sources"])
        elif (".write." in name or name.endswith(".write")) and last in WRITES:
            writes.setdefault(first)
    if not reads and not writes:
        return []
    return [{"has_docs": bool((ast.get_docstring(tree) or "").strip()), "reads": list(reads), "writes": list(writes)}]
