"""The registry of queries with the SQL each query must agree with."""


def core() -> dict:
    """Every query of the core by name."""
    from rulegrid.plans import agreement, linking, problems, reference, reports, surveys, trees

    out: dict = {}
    for module in (problems, reference, linking, agreement, surveys, trees, reports):
        out |= module.QUERIES
    return out
