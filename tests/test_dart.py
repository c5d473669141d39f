import pytest
from pyspark.sql import functions as F

from tessera.functions import dart
from tessera.functions.declarations import constructor_types, declarations
from tessera.operators import extract

CODE = """import 'a.dart';
// class Ghost extends Nobody {
class CartModule extends Module {
  static const String root = '/cart';
  static String again = "/cart";
  Future load(int id) { throw CartError(); }
  void load(int id) { try {} catch (Oops trace) {} on NetException { } }
  final repo = Modular.get<CartRepository>();
  final me = i.get<CartModule>();
  Bind.lazySingleton((i) => GetCartUseCase(i())),
  Bind.factory((i) => GetCartUseCase(i())),
  r.module('/pay', module: PayModule());
  on<CartOpened>((event, emit) {});
  final url = '/v1/{id}';
  final short = '/a';
}
class Plain {
}
class Généric<T> {
}
"""


@pytest.fixture(scope="module")
def facts(spark):
    c = F.col("content")
    df = spark.createDataFrame([(CODE,)], "content string")
    return df.select(
        dart.methods(c).alias("m"), dart.events(c).alias("e"), dart.api_paths(c).alias("a"), dart.route_paths(c).alias("r"), dart.error_types(c).alias("x"), dart.declared(c).alias("d")
    ).first()


def test_facts(facts):
    assert facts.m == ["load"]
    assert facts.e == ["CartOpened"]
    assert facts.a == ["/cart", "/pay", "/v1/{id}"]
    assert facts.r == ["/cart", "/cart"]
    assert facts.x == ["CartError", "trace", "NetException"]
    assert [(d["name"], d["base"]) for d in facts.d] == [("Ghost", "Nobody"), ("CartModule", "Module"), ("Plain", ""), ("Généric", "")]


FILES = [("shop", "shop/lib/cart.dart", CODE), ("shop", "shop/lib/cart_event.dart", "class OpenEvent {}\nclass CloseEvent {}\n"), ("shop", "shop/lib/o2nd_state.dart", "class AState {}"), ("shop", "shop/lib/nul.dart", None), ("pay", "pay/lib/z.dart", "class Plain extends Base {\n}\n"), ("pay", "pay/lib/empty_event.dart", "")]


def test_graph(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, content string")
    regex = extract.knowledge_graph(files)
    edges = {(r.src, r.dst, r.edge_type) for r in regex["edges"].collect()}
    assert ("Ghost", "CartRepository", "depends_on") in edges and ("CartEvent".replace("Event", "Bloc"), "CartEvent", "has_part") in edges
    scan = extract.knowledge_graph(files, "scan")
    edges = {(r.src, r.dst, r.edge_type) for r in scan["edges"].collect()}
    assert edges == {("CartModule", "CartRepository", "depends_on"), ("CartModule", "GetCartUseCase", "binds"), ("CartModule", "PayModule", "routes_to"), ("CartBloc", "CartEvent", "has_part"), ("O2NdBloc", "O2NdState", "has_part")}
    nodes = {r.id: r for r in scan["nodes"].collect()}
    assert nodes["Plain"].repo == "pay" and nodes["Plain"].base_class == "Base"
    assert nodes["CartEvent"].classes == ["OpenEvent", "CloseEvent"] and nodes["O2NdState"].node_type == "State"
    mapping = {r.id: (r.path, r.line) for r in scan["file_map"].collect()}
    assert mapping["Plain"] == ("shop/lib/cart.dart", 17) and mapping["CartEvent"] == ("shop/lib/cart_event.dart", 1)
    lines = {(r.name, r.line) for r in extract.declared_classes(files).collect()}
    assert ("CartModule", 3) in lines and ("Généric", 19) in lines
    assert extract.knowledge_graph(files.limit(0), "scan")["nodes"].count() == 0


@pytest.mark.parametrize(
    "name, base, kind",
    [("CartViewModel", "", "UI"), ("StorePage", "", "Controller"), ("ApiModel", None, "Repository"), ("X", "ChildModule", "Module"), ("CartEventBus", "", "Unknown"), ("CartEvent", "", "Event"), ("Routes", "", "Route"), ("CartTile", "", "Widget")],
)
def test_types(spark, name, base, kind):
    df = spark.createDataFrame([(name, base)], "n string, b string")
    assert df.select(dart.node_type(F.col("n"), F.col("b"))).first()[0] == kind


def test_summary(spark):
    df = spark.createDataFrame([("UI", "Mixin", ["a", None, "b"], None, ["/p"]), ("UI", "Base", ["a"], ["e1", "e2", "e3", "e4"], None), ("UI", None, None, None, None)], "t string, b string, m array<string>, e array<string>, p array<string>")
    assert [r[0] for r in df.select(dart.summary(*map(F.col, "tbmep"))).collect()] == ["UI | fn:a,b | api:/p", "UI | extends Base | on<e1,e2,e3>", "UI"]


def test_scanner():
    text = "/* class No {} */\nabstract\nclass A<T extends B> extends C<D> with E {\n  var s = 'class X {';\n  void f() { class_y(); }\n}\nmixin M on A {}\nextension Ex on String { }\nextension on int {}\nmixin class Both {}\nclass Cut extends"
    assert declarations(text) == [("class", "A", "C", 2), ("mixin", "M", "Mixin", 7), ("extension", "Ex", "String", 8), ("class", "Both", "", 10), ("class", "Cut", "", 11)]
    assert declarations("") == [] and declarations("}}}} class Q {") == [("class", "Q", "", 1)]


def test_constructor_types():
    text = "class A {\n  A(Repo? r, {required List<int> xs, this.y, final Api? api = null}) {}\n  void f(No n) {}\n}\nclass B { B(this.x); }"
    assert constructor_types(text) == [("A", "Repo"), ("A", "List<int>"), ("A", "Api")]
