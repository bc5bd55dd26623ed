"""tidemark: goal, planning and stock data jobs as Spark DataFrame functions."""
