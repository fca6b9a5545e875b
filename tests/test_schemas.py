"""Readers of DDL, Prisma, tbls and mapped JSON."""

import json

from textloom.sources.schemas import json_values, routes, schema_nodes, statements, value_places

DDL = """-- é: a; comment
create table if not exists Shop.Orders (
  id bigint not null, total numeric(10, 2) default 0, tags text [] , "Käufer" int references people(id),
  constraint pk primary key (id), constraint fk foreign key (id) references other.things (id), unique (id)
);
CREATE OR REPLACE VIEW active AS SELECT * FROM orders WHERE note = 'x;y';
create function touch(a int,
   b text) returns trigger as $body$ begin update orders set x = 1; return new; end $body$ language plpgsql;
create trigger t1 after insert on shop.orders for each row execute function touch();
create policy p1 on shop.orders for select using (true);
alter table only shop.orders add constraint f2 foreign key (id) references late(id);
create index i on orders (id)"""


def test_statements_and_places():
    found = [DDL.encode()[a:b].decode() for a, b, _ in statements(DDL.encode().decode("latin-1"))]
    assert len(found) == 7 and found[1].endswith("'x;y'") and found[2].endswith("plpgsql") and found[6] == "create index i on orders (id)"
    data = '{"é": [1, {"b": "x,}"}], "c": {}}'.encode()
    assert {k: data[a:b].decode() for k, (a, b) in value_places(data).items()} == {"": data.decode(), "é": '[1, {"b": "x,}"}]', "é/#0": "1", "é/#1": '{"b": "x,}"}', "é/#1/b": '"x,}"', "c": "{}"}


PRISMA = """// model Not { }
model OrderLine {
  id    Int    @id @map("line_id")
  order Order  @relation(fields: [orderId], references: [id])
  lines OrderLine[]
  note  String? // "{"
  @@map("order_lines")
}
model Order { 
  id Int
  @@schema("sales")
}
enum Kind { A }
"""
TBLS = {"tables": [
    {"name": "public.a", "type": "BASE TABLE", "columns": [{"name": "id", "type": "int"}], "triggers": [{"name": "tr", "def": "CREATE TRIGGER tr EXECUTE FUNCTION app.f(1)"}]},
    {"name": "b", "type": "BASE TABLE", "columns": [], "constraints": [{"type": "foreign key", "referenced_table": "a"}]},
    {"name": "v", "type": "VIEW", "def": "select orders from b"}],
    "relations": [{"table": "public.a", "parent_table": "b", "virtual": True}, {"table": "public.a", "parent_table": "c"}], "functions": [{"name": "f", "type": "PROCEDURE", "arguments": "x int"}]}
MAPPED = {"schemas": {"s": {"tables": {"t": {"columns": {"id": {"type": "int"}, "n": {}}, "fks": [{"references": "s.u.id", "on": False}, {"references": "db.e.s.w.x"}, {"references": "bad"}]}}}}}


def test_schemas_by_route(spark):
    manifest = {"datasources": {
        "app": {"engine": "PostgreSQL", "sources": [{"path": "./app.sql"}, {"path": "m.prisma"}, {"path": "../x.sql"}, {"path": "odd.txt"}, {"path": "bad.sql"}]},
        "dump": {"sources": [{"path": "dump.json"}, {"path": "app.sql"}], "json": {"preset": "tbls"}},
        "map": {"sources": [{"path": "map.json"}], "json": {"mapping": {"tables": "schemas.*.tables.*", "columns": "columns.*", "foreign_keys": "fks[]", "fk_enforced": "field:on"}}},
        "none": {}}}
    found, errors = routes(json.dumps(manifest))
    assert [r["path"] for r in found] == ["app.sql", "m.prisma", "bad.sql", "dump.json", "map.json"] and len(errors) == 4
    assert routes("x")[0] == [] and routes("[]")[1] and routes("{}")[1]
    files = [("app.sql", DDL), ("m.prisma", PRISMA), ("bad.sql", "select 1"), ("dump.json", json.dumps(TBLS)), ("map.json", json.dumps(MAPPED)), ("other.sql", DDL), (None, DDL)]
    df = spark.createDataFrame(files, "path string, content string")
    n = {(r["path"], r["node_id"]): r for r in schema_nodes(df, found).collect()}
    t = n["app.sql", "db.app.shop.orders"]
    assert t["params"] == ["id bigint", "total numeric(10, 2)", "tags text []", "Käufer int"] and not t["partial"]
    assert t["supers"] == ["db.app.public.people", "db.app.other.things", "db.app.public.late"] and DDL.encode()[t["start_byte"] : t["end_byte"]].startswith(b"create table if")
    assert "orders" in n["app.sql", "db.app.public.active"]["calls"] and n["app.sql", "db.app.public.touch"]["params"] == ["a int, b text"]
    assert n["app.sql", "db.app.shop.orders.t1"]["supers"] == ["db.app.shop.orders", "db.app.public.touch"] and n["app.sql", "db.app.shop.orders.rls.p1"]["params"] == ["p1 SELECT"]
    line = n["m.prisma", "db.app.public.order_lines"]
    assert line["params"] == ["line_id Int", "note String?"] and line["supers"] == ["db.app.sales.Order"] and line["aliases"] == ["OrderLine", "orderLine"]
    assert n["m.prisma", "db.app.sales.Order"]["aliases"] == ["order"]
    a = n["dump.json", "db.dump.public.a"]
    assert (a["supers"], a["logical_refs"], a["params"]) == (["db.dump.main.c"], ["db.dump.main.b"], ["id int"])
    assert n["dump.json", "db.dump.main.b"]["supers"] == ["db.dump.main.a"] and n["dump.json", "db.dump.main.v"]["kind"] == "view"
    assert n["dump.json", "db.dump.public.a.tr"]["supers"] == ["db.dump.public.a", "db.dump.app.f"] and n["dump.json", "db.dump.main.f"]["kind"] == "procedure"
    m = n["map.json", "db.map.s.t"]
    assert (m["params"], m["supers"], m["logical_refs"]) == (["id int", "n"], ["db.e.s.w"], ["db.map.s.u"])
    assert n["bad.sql", "bad.sql"]["partial"] and n["bad.sql", "bad.sql"]["kind"] == "file" and not any(p in ("other.sql", None) for p, _ in n)
    assert json_values(df).filter("path = 'map.json' and value_path = 'schemas/s/tables/t/fks/#2/references'").count() == 1
    broken = spark.createDataFrame([("app.sql", "create table a (x int); create table b (y int")], "path string, content string")
    assert [(r["node_id"], r["partial"]) for r in schema_nodes(broken, found).collect()] == [("db.app.public.a", True)]
    assert schema_nodes(df.limit(0), []).count() == 0
