"""Types, members, calls and complexity of sources in seven languages, counted by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stratograph.functions.code import GRAPH_LANGUAGES, language
from stratograph.operators import syntax

SHOP = """using System;
using Shop.Data;
namespace Shop.Api
{
    // class Ghost { void Boo() { } }
    [ApiController]
    [Route("api/[controller]")]
    public class OrderController : ControllerBase, IOrders<int>
    {
        private readonly Dictionary<string, int> cache = new Dictionary<string, int>();
        public string Name { get; set; }
        public int Size => cache.Count;
        public OrderController(IStore store) : base(store)
        {
            this.store = store;
        }
        [HttpGet("{id}")]
        public int Run(int a, string s = "if (x) {")
        {
            if (a > 1 && a < 9) { return a > 5 ? 1 : 2; }
            else if (a == 0 || a == 1) { Log("x"); }
            foreach (var x in cache) { Helper.Fix(x); }
            switch (a) { case 1: break; case 2: break; default: break; }
            try { var o = new Order(); o.Close(); } catch (Exception) { }
            for (int i = 0; i < 9; i++) { }
            while (a > 0) a--;
            return Twice(a);
        }
        private int Twice(int a) => Helper.Fix(a) + a;
        private void Log(string s) { Console.WriteLine(s); }
        class Inner { void Deep() { if (true) { } } }
    }
    public interface IOrders<T> { int Run(int a, string s); }
    public enum Color { Red, Green = 2, Blue }
    public record Point(int X, int Y) : Shape;
    static class Helper { public static int Fix(int a) { return a; } }
    public class Order { public void Close() { } }
}
"""
CART = '''import os
from shop.base import Base

@register("cart")
class Cart(Base, metaclass=Meta):
    """if in a docstring: {"""

    def __init__(self, items={}):
        self.items = {
            "a": 1,
        }

    @property
    def total(self):
        if self.items and len(self.items) > 1:
            return sum(x for x in self.items)
        elif os.path:
            return self.other()
        return 0

    def other(self):
        try:
            while True:
                break
        except ValueError:
            pass

def main():
    cart = Cart()
    cart.other()


if __name__ == "__main__":
    main()
'''
APP = """import { Base } from './base.js';
const fs = require("fs");
export class View extends Base {
  constructor(a) { super(a); this.a = a; }
  draw(x) {
    if (x) { this.paint(x ? 1 : 2); }
    return [1, 2].map(function (y) { return y; });
  }
  async paint(y) { for (const z of y) { await save(z); } }
}
function save(z) { return `(${z}) {`; }
const load = async (a) => { save(a); };
/* function ghost() { } */
"""
API = """export interface Store<T> extends Base { size: number; get(id: string): T; }
class Memory<T> implements Store<T>, Closable {
  get(id: string): T { return this.find(id)!; }
  private find(id: string): T { return new Map<string, T>().get(id); }
}
"""
BANK = """package shop;
import java.util.List;
import static shop.Tools.fix;
@Service
public abstract class Bank<T extends Money> extends Base<T> implements Vault, Closeable {
    @Override
    public List<T> all(int a) throws IOException { return fix(a); }
    abstract void open(int key);
    Bank() { open(1); }
    Runnable later() { return new Runnable() { public void run() { open(2); } }; }
}
"""
LIB = """#include <stdio.h>
#include "own.h"
#define TWICE(x) { x * 2
static int add(int a, int b) {
    for (;;) { if (a) break; }
    return a + b;
}
struct node { int value; struct node *next; };
struct node *make(int a) { return 0; }
int main(void) { printf("%d {", add(1, 2)); return 0; }
"""
BOX = """#include "base.hpp"
class Box : public Base, private shop::Lid {
public:
    int area(int a) const { return a * side(); }
};
int Box::side() { return 2; }
"""
FILES = {"api/Shop.cs": SHOP, "shop/cart.py": CART, "web/app.js": APP, "web/api.ts": API, "bank/Bank.java": BANK, "c/lib.c": LIB, "c/box.cpp": BOX}


@pytest.fixture(scope="module")
def files(spark):
    rows = [*FILES.items(), ("shop/base.py", "class Base:\n    pass\n"), ("empty.cs", ""), ("null.cs", None), ("open.cs", "class Open { void Run() { if (a) { }"), ("closed.cs", "} } class Late { }")]
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", language(F.col("path"), GRAPH_LANGUAGES))


@pytest.fixture(scope="module")
def rows(files):
    return syntax.blocks(syntax.statements(files)).cache()


@pytest.fixture(scope="module")
def found(rows):
    return {r["id"]: r for r in syntax.elements(rows).collect()}


def of(found, path):
    return {i.split("::")[1]: (r["kind"], r["line"], r["end_line"]) for i, r in found.items() if r["path"] == path}


def test_types_and_members_with_their_lines(found):
    assert of(found, "api/Shop.cs") == {
        "OrderController": ("Class", 6, 32), "OrderController.Name": ("Property", 11, 11), "OrderController.Size": ("Property", 12, 12), "OrderController.OrderController": ("Constructor", 13, 16),
        "OrderController.Run": ("Method", 17, 28), "OrderController.Twice": ("Method", 29, 29), "OrderController.Log": ("Method", 30, 30), "Inner": ("Class", 31, 31), "Inner.Deep": ("Method", 31, 31),
        "IOrders": ("Interface", 33, 33), "IOrders.Run": ("Method", 33, 33), "Color": ("Enum", 34, 34), "Point": ("Record", 35, 35), "Helper": ("Class", 36, 36), "Helper.Fix": ("Method", 36, 36), "Order": ("Class", 37, 37), "Order.Close": ("Method", 37, 37),
    }
    assert of(found, "shop/cart.py") == {"Cart": ("Class", 4, 26), "Cart.__init__": ("Constructor", 8, 11), "Cart.total": ("Method", 13, 19), "Cart.other": ("Method", 21, 26), "main": ("Function", 28, 30)}
    assert of(found, "web/app.js") == {"View": ("Class", 3, 10), "View.constructor": ("Constructor", 4, 4), "View.draw": ("Method", 5, 8), "View.paint": ("Method", 9, 9), "save": ("Function", 11, 11), "load": ("Function", 12, 12)}
    assert of(found, "web/api.ts") == {"Store": ("Interface", 1, 1), "Store.get": ("Method", 1, 1), "Memory": ("Class", 2, 5), "Memory.get": ("Method", 3, 3), "Memory.find": ("Method", 4, 4)}
    assert of(found, "bank/Bank.java") == {"Bank": ("Class", 4, 11), "Bank.all": ("Method", 6, 7), "Bank.open": ("Method", 8, 8), "Bank.Bank": ("Constructor", 9, 9), "Bank.later": ("Method", 10, 10)}
    assert of(found, "c/lib.c") == {"add": ("Function", 4, 7), "node": ("Struct", 8, 8), "make": ("Function", 9, 9), "main": ("Function", 10, 10)}
    assert of(found, "c/box.cpp") == {"Box": ("Class", 2, 5), "Box.area": ("Method", 3, 4), "Box.side": ("Method", 6, 6)}


def test_complexity_of_types_and_members(found):
    count = {i.split("::")[1]: (r["complexity"], r["walk"]) for i, r in found.items() if r["path"] in ("api/Shop.cs", "shop/cart.py", "web/app.js")}
    # Run: if, else if, foreach, for, while, &&, ||, ?: and switch twice; walked: the branches and loops, two cases, a catch
    assert count["OrderController.Run"] == (1 + 10, 1 + 8)
    # with Inner's if; methods Run, Twice, Log and Deep, properties Name and Size
    assert count["OrderController"] == (1 + 10 + 1 + 4 + 2, 1 + 8 + 1)
    assert count["Inner"] == (1 + 1 + 1, 2) and count["IOrders"] == (2, 1) and count["Point"] == (1, 1) and count["OrderController.Twice"] == (1, 1)
    assert count["Cart.total"] == (1 + 2 + 1 + 1, 1 + 3) and count["Cart.other"] == (1 + 1, 1 + 2)  # the generator's for counts
    assert count["View.draw"] == (1 + 2, 2) and count["View.paint"] == (2, 2)


def test_bases_types_and_attributes(found):
    bases = {r["name"]: r["bases"] for r in found.values() if r["bases"]}
    assert bases == {
        "OrderController": ["ControllerBase", "IOrders"], "Point": ["Shape"], "Cart": ["Base"], "View": ["Base"], "Store": ["Base"], "Memory": ["Store", "Closable"],
        "Bank": ["Base", "Vault", "Closeable"], "Box": ["Base", "shop::Lid"],
    }
    assert {r["name"]: r["type"] for r in found.values() if r["type"] != r["kind"]} == {"OrderController": "Controller", "Bank": "Service"}
    assert found["api/Shop.cs::OrderController"]["attributes"] == ["ApiController", "Route"] and found["bank/Bank.java::Bank"]["attributes"] == ["Service"]
    assert found["shop/cart.py::Cart"]["attributes"] == ["register"] and found["shop/cart.py::Cart.total"]["attributes"] == ["property"] and found["api/Shop.cs::OrderController.Run"]["attributes"] == ["HttpGet"]


def test_broken_sources(found):
    assert of(found, "open.cs") == {"Open": ("Class", 1, 1), "Open.Run": ("Method", 1, 1)} and found["open.cs::Open"]["complexity"] == 3
    assert of(found, "closed.cs") == {"Late": ("Class", 1, 1)} and not of(found, "empty.cs") and not of(found, "null.cs")


def test_enum_members_and_imports(rows, files):
    assert {r["id"] for r in syntax.enum_members(rows).collect()} == {f"api/Shop.cs::Color.{c}" for c in ("Red", "Green", "Blue")}
    used = {(r["path"], r["name"]) for r in syntax.imports(rows, files).collect()}
    assert used == {
        ("api/Shop.cs", "System"), ("api/Shop.cs", "Shop.Data"), ("shop/cart.py", "os"), ("shop/cart.py", "shop.base"), ("web/app.js", "./base.js"), ("web/app.js", "fs"),
        ("bank/Bank.java", "java.util.List"), ("bank/Bank.java", "shop.Tools.fix"), ("c/lib.c", "stdio.h"), ("c/lib.c", "own.h"), ("c/box.cpp", "base.hpp"),
    }


def test_graph_of_sources(files):
    g = syntax.syntax_graph(files)
    arcs = {(r["src"], r["dst"]) for r in g.edges.filter("type = 'Call'").collect()}
    shop, cart = "api/Shop.cs::", "shop/cart.py::"
    assert {a for a in arcs if a[0].startswith("api/")} == {
        (shop + "OrderController.Run", shop + "OrderController.Log"), (shop + "OrderController.Run", shop + "Helper.Fix"), (shop + "OrderController.Run", shop + "Order"), (shop + "OrderController.Run", shop + "Order.Close"),
        (shop + "OrderController.Run", shop + "OrderController.Twice"), (shop + "OrderController.Twice", shop + "Helper.Fix"),
    }
    assert {a for a in arcs if a[0].startswith("shop/")} == {(cart + "Cart.total", cart + "Cart.other"), (cart + "main", cart + "Cart"), (cart + "main", cart + "Cart.other")}  # the file contains main, which counts before its call
    assert {("web/app.js::View.draw", "web/app.js::View.paint"), ("web/app.js::View.paint", "web/app.js::save"), ("web/app.js::load", "web/app.js::save"), ("web/api.ts::Memory.get", "web/api.ts::Memory.find"), ("bank/Bank.java::Bank.later", "bank/Bank.java::Bank.open"), ("c/lib.c::main", "c/lib.c::add"), ("c/box.cpp::Box.area", "c/box.cpp::Box.side")} <= arcs
    edges = {(r["src"], r["dst"], r["type"]) for r in g.edges.collect()}
    assert {(cart + "Cart", "shop/base.py::Base", "Inheritance"), (shop + "OrderController", shop + "IOrders", "Implementation"), ("shop/cart.py", "shop/base.py", "Dependency"), ("api/Shop.cs", shop + "Color", "Contains"), (shop + "Color", shop + "Color.Red", "Contains"), (shop + "OrderController", shop + "OrderController.Run", "Contains")} <= edges
    nodes = {r["node_id"]: r for r in g.nodes.collect()}
    assert nodes[cart + "Cart"]["line_count"] == 23 and nodes["shop/cart.py"]["type"] == "File" and nodes["null.cs"]["line_count"] == 1


def _by_loop(tokens):
    """(head, raw, ends, line, last_line) of each statement, token by token."""
    out, held, lines, line, depth, outer = [], [], [], 1, 0, {}
    level = 0
    for tok in tokens:
        here, line = line, line + tok.count("\n")
        if tok.strip(" ") in ("", "\n") or tok.startswith(("//", "#")) or (tok.startswith("/*") and len(tok) > 3):
            continue
        level += (tok == "{") - (tok == "}")
        depth += (tok == "(") - (tok == ")")
        if tok == "{":
            outer[level] = depth
        lines.append(here)
        if tok in "{}" or (tok == ";" and depth <= outer.get(level, 0)):
            out.append((held, tok, lines))
            held, lines = [], []
        else:
            held.append(tok)
    if held:
        out.append((held, "", lines))
    quoted = re.compile(r"""[A-Za-z$@]{0,2}["'`]""")
    return [(i, " ".join('""' if quoted.match(t) else t for t in h), " ".join(h), e, min(n), max(n)) for i, (h, e, n) in enumerate(out)]


def test_only_braces_brackets_and_semicolons_are_rows(spark):
    """Statements from runs of tokens are those of a loop over all tokens, and prose is a row or two, not one a word."""
    r = random.Random(3)
    parts = ["{", "}", "(", ")", ";", "\n", "// c ; {\n", "/* a {\n b */", '"s;{"', "#x\n", "foo", "class A", "=>", '"open\n', "`t\n;`", "/*", "#", "for(i=0;i<3;i++)", "@At", ":", "\r\n", "é"]
    rows = [(f"f{i}", r.choice(["C#", "JavaScript", "Java", "Python"]), "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 50)))) for i in range(200)]
    files = spark.createDataFrame([*rows, ("none", "C#", None)], "path string, language string, content string")
    tokens = {x["path"]: x["tokens"] for x in syntax.tokens(files).collect()}
    got: dict = {}
    for x in syntax.statements(files).collect():
        got.setdefault(x["path"], []).append((x["seq"], x["head"], x["raw"], x["ends"], x["line"], x["last_line"]))
    want = {p: _by_loop(t) for p, t in tokens.items()}
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}
    prose = spark.createDataFrame([("p", "Java", "some words of prose, " * 500 + "end;")], "path string, language string, content string")
    assert syntax._runs(prose).count() == 1
