"""Reading and writing: CSV and parquet tables, stored odds pages, test inputs from orders."""
