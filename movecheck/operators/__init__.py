"""DataFrame operators: retention, renames, series, contrasts, audits, scoring."""
