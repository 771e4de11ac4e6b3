"""Services without issues are the services, whatever way they are found."""

from reportmill import catalogue


def test_places_are_the_services(spark):
    done = catalogue._consolidated(spark, "/root/testdata/sf0.001")
    rows = done.places.collect()
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, done.services.select(*done.places.columns).collect()))
