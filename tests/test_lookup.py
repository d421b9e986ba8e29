from codeweft.plans import codegraph


def test_every_name_is_looked_up(spark, smallest):
    nodes = codegraph.QUERIES["latest_node_by_id"](spark, smallest).where("name is not null").cache()
    found = codegraph.QUERIES["find_by_every_name"](spark, smallest).cache()
    assert nodes.select("name").distinct().count() > 20
    assert {r.name for r in found.select("name").collect()} == {r.name for r in nodes.select("name").collect()}
    assert found.count() == nodes.count() and found.where("lower(name) != wanted").count() == 0
