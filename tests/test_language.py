"""The language over a small library: readers, books and loans; its errors; events, snapshots and streams."""

import pytest

from loomset.plans.program import CheckProblem, Program
from loomset.sources.lexer import SyntaxProblem
from loomset.streaming.app import App, Invalid, Rejected

LIBRARY = """
type Shelf = Attic | Cellar | Hall
entity Reader { name: Text, town: Text }
entity Book { title: Text, shelf: Shelf, pages: Int, price: Money, rare: Bool }
entity Loan { book: Book, reader: Reader, days: Int, since: Date }
let ann = new Reader { name: "Ann", town: "Ulm" }
let bo = new Reader { name: "Bo", town: "Ulm" }
let cy = new Reader { name: "Cy" }
let maps = new Book { title: "Maps", shelf: Attic, pages: 120, price: 30.50, rare: True }
let moss = new Book { title: "Moss", shelf: Cellar, pages: 80, price: 12, rare: False }
let keys = new Book { title: "Keys", shelf: Cellar, pages: 0, rare: False }
let _ = new Loan { book: maps, reader: ann, days: 7, since: 2024-02-29 }
let _ = new Loan { book: maps, reader: bo, days: 21, since: 2024-03-01 }
let _ = new Loan { book: moss, reader: ann, days: -2, since: 2023-12-31 }
let lent : Book -> Loan = ~(Loan . book)
let borrowed : Reader -> Book = ~(Loan . reader) . book
"""


def rows(spark, body, view="v"):
    return sorted(tuple(r) for r in Program(spark, LIBRARY + body).view(view).collect())


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("let v : Reader -> Int = count(Loan by .reader)", [(0, 2, 1), (1, 1, 1), (2, 0, 1)]),
        ("let v = count(Book by .shelf)", [("Attic", 1, 1), ("Cellar", 2, 1), ("Hall", 0, 1)]),
        ("let v : Reader -> Int = sum(Loan.days by .reader)", [(0, 5, 1), (1, 21, 1), (2, 0, 1)]),
        ("let v = avg(Loan.days by .reader)", [(0, 250, 1), (1, 2100, 1)]),
        ("let v = max(Loan.book.pages by .reader.town)", [("Ulm", 120, 1)]),
        ("let v = min(Book.price by .shelf)", [("Attic", 3050, 1), ("Cellar", 1200, 1)]),
        ("let v : Reader -> Text = distinct (borrowed . title)", [(0, "Maps", 1), (0, "Moss", 1), (1, "Maps", 1)]),
        ("let v : Book -> Text = lent . reader . town", [(0, "Ulm", 2), (1, "Ulm", 1)]),
        ("let v : Loan = Loan where .since < 2024-03-01", [(0, 0, 1), (2, 2, 1)]),
        ("let v : Book = Book.pages > Book.price", [(0, 0, 1), (1, 1, 1)]),
        ("let v : Book -> Int = .pages / (.pages - 80)", [(0, 3, 1), (1, 0, 1), (2, 0, 1)]),
        ("let v : Loan -> Int = 9223372036854775807 + .days", [(0, -9223372036854775802, 1), (1, -9223372036854775788, 1), (2, 9223372036854775805, 1)]),
        ("let v = Book.pages | Book.pages", [(0, 120, 2), (1, 80, 2), (2, 0, 2)]),
        ('let v : Book -> Text = match .shelf { Attic => "up", _ => .title ++ "?" }', [(0, "up", 1), (1, "Moss?", 1), (2, "Keys?", 1)]),
        ("let v : Book = Book where lent", [(0, 0, 1), (1, 1, 1)]),
        ("let v : Book = Book where not lent", [(2, 2, 1)]),
        ("let v : Book = not lent", [(2, 2, 1)]),
        ("let v : Book = Book except lent", [(2, 2, 1)]),
        ("let v : Book = Book where (not lent | .rare)", [(0, 0, 1), (2, 2, 1)]),
        ("let v : Book = Book where lent & not .rare", [(1, 1, 1)]),
        ('let v : Book -> Text = if lent then .title else "in"', [(0, "Maps", 1), (1, "Moss", 1), (2, "in", 1)]),
        ("let v : Book = Book where not .rare", [(1, 1, 1), (2, 2, 1)]),
        # `except` asks whether there is a value, not whether it is True.
        ("let v : Book = Book except (.rare | .rare)", []),
        ("let v : Book = Book except .price", [(2, 2, 1)]),
        ("let v : Book = Book except (Book where .rare)", [(1, 1, 1), (2, 2, 1)]),
    ],
)
def test_views(spark, body, wanted):
    assert rows(spark, body) == wanted


TRAINS = """
entity Stop { sign: Text }
entity Track { start: Stop, stop: Stop }
let p = new Stop { sign: "p" }
let q = new Stop { sign: "q" }
let r = new Stop { sign: "r" }
let s = new Stop { sign: "s" }
let _ = new Track { start: p, stop: q }
let _ = new Track { start: q, stop: r }
let _ = new Track { start: r, stop: q }
let _ = new Track { start: r, stop: s }
let next : Stop -> Stop = Track.stop by .start
let recursive reach : Stop -> Stop = next | next . reach
let recursive uneven : Stop -> Stop = next | next . even
let recursive even : Stop -> Stop = next . uneven
"""


def test_recursion_ends_on_cycles(spark):
    program = Program(spark, TRAINS)
    pairs = lambda v: sorted((x["l"], x["r"]) for x in program.view(v).collect())
    assert pairs("reach") == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert pairs("uneven") == [(0, 1), (0, 3), (1, 2), (2, 1), (2, 3)]
    assert pairs("even") == [(0, 2), (1, 1), (1, 3), (2, 2)]


@pytest.mark.parametrize("body", ["let v : Book -> Money = .price * .price", "let v = Reader.name + Reader.name", "let recursive v : Book -> Book = Book except v", "let v : Book = .shelf in (Garden)", "let v = nobody"])
def test_type_errors(spark, body):
    with pytest.raises(CheckProblem):
        Program(spark, LIBRARY + body).view("v")


@pytest.mark.parametrize("body", ["let lent = Book", "entity Book { name: Text }", "type Lost = Hall | Gone", "state ann : Int = 1", "entity Int { a: Text }"])
def test_names_are_declared_once(spark, body):
    with pytest.raises(CheckProblem, match="twice|two types"):
        Program(spark, LIBRARY + body)


@pytest.mark.parametrize("source", ["let", "entity A { x }", "let x : A = 2026-02-30", "let x = 9223372036854775808"])
def test_syntax_errors(spark, source):
    with pytest.raises(SyntaxProblem):
        Program(spark, source)


STOCK = """
type Mode = Whole | Low
entity Good { name: Text, left: Int, closed: Bool }
entity Bin { good: Good, place: Text, key (good, place) }
state mode : Mode = Whole
event Stock(name: Text, left: Int)
event Close(g: Good)
event Trade(a: Good, b: Good)
event Look(m: Mode)
event Sweep()
event Store(g: Good, place: Text)
event Deliver(goods: Int -> Text)
event Wrong()
on Stock(name, left) where (left > 0) else "nothing" => new Good { name: name, left: left, closed: False }
on Close(g) => g.closed := not g.closed
on Trade(a, b) { a.left := b.left
  b.left := a.left }
on Look(m) => set mode = m
on Sweep() => delete Good where .closed
on Store(g, place) => new Bin { good: g, place: place }
on Deliver(goods) => new Good from goods as (i, g) { name: g, left: i, closed: False }
on Wrong() => update (Bin . good) { left: 0 }
let seen : Good = match mode { Whole => Good, Low => Good where .left < 5 }
let total : Unit -> Int = sum(Good.left by unit)
"""


def test_events(spark, tmp_path):
    app = App(spark, STOCK)
    goods = lambda a: sorted((r["name"], r["left"]) for r in a.program.frame("Good").collect())
    change = app.dispatch("Stock", "tea", 9, watch=["total"])["total"]
    assert sorted(tuple(r) for r in change.collect()) == [(0, 0, -1), (0, 9, 1)]
    app.dispatch("Stock", "oil", 2)
    app.dispatch("Trade", 0, 1)
    assert goods(app) == [("oil", 9), ("tea", 2)]
    app.dispatch("Look", "Low")
    assert [tuple(r) for r in app.view("seen").collect()] == [(0, 0, 1)]
    with pytest.raises(Rejected, match="nothing"):
        app.dispatch("Stock", "air", 0)
    with pytest.raises(Invalid):
        app.dispatch("Stock", 4, 4)
    app.dispatch("Store", 1, "left")
    with pytest.raises(Rejected, match="already exists"):
        app.dispatch("Store", 1, "left")
    with pytest.raises(Invalid, match="set of rows"):
        app.dispatch("Wrong")
    app.dispatch("Close", 0)
    app.dispatch("Sweep")
    app.dispatch("Deliver", [[5, "jam", 1], [3, "ice", 1], [1, "fog", 0]])
    assert goods(app) == [("ice", 3), ("jam", 5), ("oil", 9)]
    assert goods(App.replay(spark, STOCK, app.log)) == goods(app)
    app.snapshot(str(tmp_path / "at"))
    again = App.restore(spark, STOCK, str(tmp_path / "at"))
    again.dispatch("Stock", "rye", 4)
    # Onto the folder whose tables the app reads.
    again.snapshot(str(tmp_path / "at"))
    assert goods(App.restore(spark, STOCK, str(tmp_path / "at"))) == goods(again) == sorted([*goods(app), ("rye", 4)])


def test_a_stream_is_followed_on_after_a_restart(spark, tmp_path):
    kinds = "id long, name string, left long, closed string, w long"
    put = lambda n, *r: spark.createDataFrame(list(r), kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    put(0, (0, "tea", 3, "False", 1), (1, "oil", 4, "False", 1))
    App(spark, STOCK).follow(stream(), "Good", ["total"], out, marks).awaitTermination()
    put(1, (0, "tea", 3, "False", -1))
    with pytest.raises(Invalid, match="restore"):
        App(spark, STOCK).follow(stream(), "Good", ["total"], out, marks)
    app = App.restore(spark, STOCK, f"{out}/_state")
    assert app.applied == {"Good": 0}
    app.follow(stream(), "Good", ["total"], out, marks).awaitTermination()
    got = sorted((r["batch"], r["r"], r["w"]) for r in spark.read.parquet(f"{out}/total").collect())
    assert got == [(0, 0, -1), (0, 7, 1), (1, 4, 1), (1, 7, -1)]
    assert App.restore(spark, STOCK, f"{out}/_state").applied == {"Good": 1}


TREE = """
entity Node { name: Text, parent: Node, size: Int, cost: Money }
let a = new Node { name: "a", size: 3, cost: 0.03 }
let b = new Node { name: "b", parent: a, size: 3, cost: 3.00 }
let c = new Node { name: "c", parent: a, size: 5 }
let d = new Node { name: "d", parent: b, cost: 9 }
let kids : Node -> Node = ~(Node . parent)
"""


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("let v = Node.parent . (kids | kids)", [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 3, 2)]),
        ("let v = Node.parent . (distinct kids)", [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1)]),
        ("let v = Node.parent . kids", [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1)]),
        ("let v = Node.parent . ~(Node . parent)", [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1)]),
        ("let v = a . ~(Node . parent)", [(0, 1, 1), (0, 2, 1)]),
        ("let v = a . kids", [(0, 1, 1), (0, 2, 1)]),
        ("let v = Node.parent.parent", [(3, 0, 1)]),
        ("let v = Node.parent . (count(kids))", [(1, 2, 1), (2, 2, 1), (3, 1, 1)]),
        ("let v = Node.parent . (kids . name)", [(1, "b", 1), (1, "c", 1), (2, "b", 1), (2, "c", 1), (3, "d", 1)]),
        # 3 and 3.00 are one amount, 3 and 0.03 are not.
        ("let v = Node.size | Node.cost", [(0, 3, 1), (0, 300, 1), (1, 300, 2), (2, 500, 1), (3, 900, 1)]),
        ("let v = Node.size & Node.cost", [(1, 300, 1)]),
        ("let v : Node -> Money = if .size = 3 then .size else .cost", [(0, 300, 1), (1, 300, 1), (3, 900, 1)]),
        ('let v : Node -> Money = match .name { "a" => .size, _ => .cost }', [(0, 300, 1), (1, 300, 1), (3, 900, 1)]),
    ],
)
def test_relations_at_a_path_and_amounts(spark, body, wanted):
    assert sorted(tuple(r) for r in Program(spark, TREE + body).view("v").collect()) == sorted(wanted)
