"""Table-to-table steps: team records, forecast models, betting lines, reshaping."""
