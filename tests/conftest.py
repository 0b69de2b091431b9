import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from days import DAY0, day  # noqa: E402
from eventloom.schema import EVENT_SCHEMA  # noqa: E402
from eventloom.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture
def make_events(spark):
    def build(rows, domain="measurement"):
        out = []
        for i, row in enumerate(rows):
            full = {f: None for f in EVENT_SCHEMA.names}
            full.update(event_id=i, domain=domain, person_id=1)
            full.update({k: v for k, v in row.items() if k != "day"})
            full["event_date"] = day(row["day"]) if "day" in row else row.get("event_date")
            out.append(tuple(full[f] for f in EVENT_SCHEMA.names))
        return spark.createDataFrame(out, EVENT_SCHEMA)

    return build


@pytest.fixture
def cohort(spark):
    return spark.createDataFrame([(1, DAY0), (2, DAY0)], "person_id BIGINT, index_date DATE")


@pytest.fixture
def vocabulary(spark):
    from eventloom.operators.concepts import Vocabulary

    schema = (
        "concept_id BIGINT, concept_name STRING, concept_code STRING, vocabulary_id STRING, domain_id STRING, "
        "standard_concept STRING, concept_class_id STRING"
    )
    rows = [
        (1, "Marker alpha", "1-1", "LOINC", "Measurement", "S", "Lab"),
        (2, "Marker beta", "2-2", "LOINC", "Measurement", "S", "Lab"),
        (3, "Old marker", "1-1", "LOINC", "Measurement", None, "Lab"),
        (10, "Disease", "D", "SNOMED", "Condition", "S", "Class"),
        (11, "Disease of the left", "DL", "SNOMED", "Condition", "S", "Item"),
        (20, "Steroid", "R1", "RxNorm", "Drug", "S", "Ingredient"),
        (21, "Steroid 5 MG", "R2", "RxNorm", "Drug", "S", "Clinical Drug"),
    ]
    closure = [(i, i) for i, *_ in rows] + [(10, 11), (20, 21)]
    return Vocabulary(spark.createDataFrame(rows, schema), spark.createDataFrame(closure, "ancestor_concept_id BIGINT, descendant_concept_id BIGINT"))
