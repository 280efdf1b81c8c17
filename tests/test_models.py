"""Model files and their resolution, over a lending library's models."""

from __future__ import annotations

import pytest

from semaspark.plans.model import ModelError, Workspace, resolve
from semaspark.plans.modelfile import ModelSyntaxError, read_model

BOOKS = """view: books {
  sql_table_name: lib.books ;;
  dimension: isbn {
    primary_key: yes
    sql: ${TABLE}.isbn ;;
  }
  dimension: shelf {
    sql: ${TABLE}.shelf ;;
    label: "Shelf"
  }
  measure: copies {
    type: sum
    sql: ${TABLE}.copies ;;
  }
}
"""


@pytest.fixture
def library(tmp_path):
    """Writes files by path, and reads them as projects."""

    def made(files: dict[str, str]) -> Workspace:
        for path, text in files.items():
            at = tmp_path / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
        return Workspace(sorted({tmp_path / path.split("/")[0] for path in files}))

    return made


def test_a_view_keeps_its_values_and_lines():
    (view,) = read_model(BOOKS, "books")
    shelf, copies = view.all("dimension")[1], view.all("measure")[0]
    assert (view.name, view.get("sql_table_name")) == ("books", "lib.books")
    assert (shelf.name, shelf.line, shelf.get("label")) == ("shelf", 7, "Shelf") and (copies.get("type"), copies.line) == ("sum", 11)


def test_escapes_lists_and_filters():
    (view,) = read_model('view: loans { measure: late { filters: [days: ">14", shelf: "-K"] tags: ["certified", open] description: "a \\"long\\" loan" } }')
    late = view.all("measure")[0]
    assert late.get("filters") == [("days", ">14"), ("shelf", "-K")] and late.get("tags") == ["certified", "open"] and late.get("description") == 'a "long" loan'


def test_an_exemption_counts_for_what_follows_it():
    (view,) = read_model("view: v {\n  # lint: disable LNT001 reason=kept for old reports\n  dimension: a {}\n  dimension: b {}\n}\n")
    a, b = view.all("dimension")
    assert a.exempt == {"LNT001"} and not b.exempt


@pytest.mark.parametrize("broken", ["view: books {", 'label: "open', "sql: no end", "}", "view books {}", "tags: [one"])
def test_broken_files_name_file_and_line(broken):
    with pytest.raises(ModelSyntaxError, match="desk:1"):
        read_model(broken, "desk")


def test_later_refinements_win_and_leave_the_owner_alone(library):
    space = library({
        "central/manifest.lkml": 'project_name: "central"\n', "central/c.model.lkml": 'include: "/books.view"\n', "central/books.view.lkml": BOOKS,
        "branch/manifest.lkml": 'project_name: "branch"\nlocal_dependency: { project: "central" }\n',
        "branch/b.model.lkml": 'include: "//central/books.view"\ninclude: "/late.view"\ninclude: "/early.view"\n',
        "branch/early.view.lkml": 'view: +books { dimension: shelf { label: "Place" } }\n',
        "branch/late.view.lkml": 'view: +books {\n  dimension: shelf { label: "Rack" }\n  dimension: floor { sql: 2 ;; }\n}\n',
    })
    branch, central = resolve(space, "branch"), resolve(space, "central")
    shelf = branch.field("books", "shelf")
    assert shelf.get("label") == "Place" and [p.file.split("/")[-1] for _, p in shelf.history] == ["books.view.lkml", "late.view.lkml", "early.view.lkml"]
    assert shelf.places["sql"].project == "central" and shelf.places["label"].project == "branch"
    assert central.field("books", "shelf").get("label") == "Shelf" and central.field("books", "floor") is None and branch.problems == []
    assert space.tree() == "branch <= central as local_dependency\ncentral <= nothing\n"
    assert space.mermaid() == "flowchart TB\n    central -. local_dependency .-> branch\n"


def test_an_extension_takes_over_and_overrides(library):
    m = resolve(library({"p/p.model.lkml": BOOKS + """
view: rare_books { extends: [books] dimension: shelf { label: "Vault" } }
explore: all { view_name: books sql_always_where: ${books.copies} > 0 ;; }
explore: rare { extends: [all] label: "Rare" }
"""}), "p")  # fmt: skip
    shelf, rare = m.field("rare_books", "shelf"), m.explores["rare"]
    assert shelf.get("label") == "Vault" and shelf.get("sql") == "${TABLE}.shelf" and shelf.history[-1][0] == "override"
    assert rare.get("view_name") == "books" and rare.get("sql_always_where") == "${books.copies} > 0" and rare.get("label") == "Rare"
    assert m.field("books", "shelf").get("label") == "Shelf"


def test_what_does_not_resolve_is_a_problem(library):
    m = resolve(library({"p/p.model.lkml": 'include: "/gone/*.view"\ninclude: "//elsewhere/*.view"\nview: +missing { dimension: x {} }\nview: a {}\nview: a {}\n'}), "p")
    for part in ("matched no files", "elsewhere", "refinement of unknown view 'missing'", "defined twice"):
        assert any(part in p for p in m.problems), (part, m.problems)


def test_cycles_are_refused(library):
    with pytest.raises(ModelError, match="extends cycle: x -> y -> z -> x"):
        resolve(library({"p/p.model.lkml": "view: x { extends: [y] }\nview: y { extends: [z] }\nview: z { extends: [x] }\n"}), "p")
    ring = {f"{n}/manifest.lkml": f'project_name: "{n}"\nlocal_dependency: {{ project: "{m}" }}\n' for n, m in (("north", "south"), ("south", "north"))}
    with pytest.raises(ModelError, match="north"):
        library(ring)


def test_a_project_reached_twice_is_read_once(library):
    needs = lambda name, *others: f'project_name: "{name}"\n' + "".join(f'local_dependency: {{ project: "{o}" }}\n' for o in others)
    m = resolve(library({
        "core/manifest.lkml": needs("core"), "core/books.view.lkml": BOOKS, "loans/manifest.lkml": needs("loans", "core"), "fees/manifest.lkml": needs("fees", "core"),
        "desk/manifest.lkml": needs("desk", "loans", "fees", "core"), "desk/d.model.lkml": 'include: "//core/books.view"\ninclude: "//core/*.view"\n',
    }), "desk")
    assert m.imports == ["core", "fees", "loans"] and m.field("books", "copies").type == "sum" and m.problems == []
