"""Reading and writing datasets, models and call logs."""
