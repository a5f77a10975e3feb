"""Comparison of results."""


def rows_of(pdf):
    """Rows as sorted strings, with columns by name and nulls alike."""
    columns = sorted(pdf.columns)
    return sorted(map(str, pdf[columns].astype(object).where(pdf[columns].notna(), None).itertuples(index=False, name=None)))
