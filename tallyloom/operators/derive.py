"""Transaction-aware derived columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom import fixed
from tallyloom.schema import MONEY


def add_derived(
    df: DataFrame,
    amount: Column | None,
    shipping: Column | None = None,
    quantity: Column | None = None,
) -> DataFrame:
    """Add revenue_calc, shipping_loss_calc, units_sold_calc and needs_estimation.

    A shipment earns its absolute amount and sells its units, a refund takes back its
    amount and loses its shipping, a free replacement only asks for an estimate. A missing
    amount, any other type, or an upload without an amount column (``None``) gives zeros.
    """
    zero = F.lit(0).cast(MONEY)
    if amount is None:
        return df.withColumns(
            {
                "revenue_calc": zero,
                "shipping_loss_calc": zero,
                "units_sold_calc": F.lit(0),
                "needs_estimation": F.lit(False),
            }
        )
    kind = F.col("transaction_type")
    shipping = zero if shipping is None else shipping
    quantity = F.lit(0) if quantity is None else quantity
    sold = (kind == fixed.SHIPMENT) & amount.isNotNull()
    returned = (kind == fixed.REFUND) & amount.isNotNull()
    return df.withColumns(
        {
            "revenue_calc": F.when(sold, F.abs(amount)).when(returned, -F.abs(amount)).otherwise(zero).cast(MONEY),
            "shipping_loss_calc": F.coalesce(F.when(returned, F.abs(shipping)), zero).cast(MONEY),
            "units_sold_calc": F.coalesce(F.when(sold, quantity), F.lit(0)).cast("int"),
            "needs_estimation": F.coalesce(kind == fixed.FREE_REPLACEMENT, F.lit(False)),
        }
    )
