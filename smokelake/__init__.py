"""smokelake: DataFrame operators for aerial smoke monitoring tables and streams."""
