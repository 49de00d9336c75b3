"""Declared schemas of the inputs."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    types = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    pairs = [p.split() for p in spec.split(",")]
    return T.StructType([T.StructField(n, types[t]) for n, t in pairs])


GBD = _struct(
    "measure_id int, measure_name string, location_id int, location_name string, sex_id int,"
    " sex_name string, age_id int, age_name string, cause_id int, cause_name string,"
    " metric_id int, metric_name string, year int, val double, upper double, lower double"
)
CROSSWALK = _struct("location_id int, iso_code string, location_name string")
INCOME = _struct("iso_code string, income_level string")
REGION = _struct("iso_code string, who_region string, ihme_region string")
BOUNDARY = _struct("gu_a3 string, adm0_a3 string")
INPUTS = _struct("ihme_region string, inputs_mental int, inputs_maternal int, inputs_all int")
