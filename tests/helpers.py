"""What several tests use."""


def rows(df, *order):
    """The rows as tuples, sorted so that tests do not depend on partitioning."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
