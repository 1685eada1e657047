"""Reading tables and writing stages."""
