"""Column expressions: strings, dates, indices, time series and geometry."""
