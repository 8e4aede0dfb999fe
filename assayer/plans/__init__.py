"""Registered queries: each pairs a Spark query with the SQL that must give the same rows."""


def registry() -> dict:
    from assayer.plans import cataloguing, profiling, searching

    return {**profiling.QUERIES, **cataloguing.QUERIES, **searching.QUERIES}
