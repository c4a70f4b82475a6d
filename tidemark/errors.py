"""What goes wrong with series and with trades."""


class MetricsError(Exception):
    pass


class EmptySeriesError(MetricsError):
    pass


class InsufficientDataError(MetricsError):
    def __init__(self, required: int, actual: int, metric: str = ""):
        super().__init__(f"{metric or 'metric'} needs {required} rows, got {actual}")
        self.required, self.actual, self.metric = required, actual, metric


class BenchmarkMismatchError(MetricsError):
    pass


class InvalidFrequencyError(MetricsError):
    pass


class InvalidTradeDataError(Exception):
    pass


class MissingColumnError(InvalidTradeDataError):
    pass


class InvalidPriceError(InvalidTradeDataError):
    pass


class InvalidDirectionError(InvalidTradeDataError):
    pass


class InvalidTradeTimesError(InvalidTradeDataError):
    pass
