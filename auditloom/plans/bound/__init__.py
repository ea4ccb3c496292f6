"""Every operator bound to the driver tables, with the SQL that must give the same rows."""


def registered():
    """(queries, oracles) of all bound modules."""
    from auditloom.plans.bound import base, corpus, documents, graphs, rich, tables  # noqa: F401

    return base.QUERIES, base.ORACLES
